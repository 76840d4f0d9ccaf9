"""Exact groups, and archives: round trips and edge cases."""

import hashlib
import random
from collections import defaultdict

import pyarrow.fs as pafs
import pytest
import zstandard

from spanguard.llm import warc
from spanguard.llm.exact_dedup import exact_groups

DOCS = "doc_id long, text string, kept string, digit int"
PAGES = "page_id long, url string, html string, frame string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("first_digit", [1, 7, 64])
def test_exact_groups_against_brute_force(spark, first_digit):
    r = random.Random(first_digit)
    base = ["", "a", "ab" * 40, "É" * 70, "x" * 600, "x" * 601, "q" * 5000 + "1", "q" * 5000 + "2"]
    texts = [r.choice(base) for _ in range(60)] + [t.upper() for t in base] + [None, "é" * 70, "z" * 64, "z" * 65]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/exact-{first_digit}"
    spark.createDataFrame(rows, DOCS).repartition(3, "doc_id").write.mode("overwrite").parquet(path)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    got = exact_groups(spark.read.parquet(path), first_digit=first_digit).collect()
    assert len(got) == len(texts)
    for g in got:
        same = groups[lower(texts[g.doc_id])]
        assert (g.keep_id, g.group_size, g.kept) == (max(same), len(same), g.doc_id == max(same))
        assert g.text_sha256 == hashlib.sha256(lower(texts[g.doc_id]).encode()).hexdigest()


def test_exact_groups_with_null_and_repeated_ids(spark):
    rows = [(None, "A", "", 0), (None, "a", "", 0), (3, "b", "", 0), (3, "B", "", 0), (None, "b", "", 0), (4, None, "", 0), (5, "", "", 0)]
    got = exact_groups(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted((r.keep_id or -1, r.group_size) for r in got) == [(-1, 2)] * 2 + [(3, 3)] * 3 + [(5, 2)] * 2
    assert sorted(r.keep_id or -1 for r in got if r.kept) == [-1, 3, 5]
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def pages():
    big = "é" * 700
    rows = [(1, "http://a/ b\r\nX: y", big, "f"), (2, None, big, None), (9, "u", big, ""), (3, "u", "klein", ""), (4, "u", "klein", "")]
    rows += [(5, "u", None, ""), (6, "u", "", ""), (7, "u", "x" * 999, ""), (8, "u", "x" * 999, ""), (10, "u", "WARC/1.1\r\n\r\n" * 300, "")]
    return [*rows, (None, "u", big, ""), (9, "u", big, ""), (11, "u", "y" * 90_000, "")]


def test_archives_round_trip(spark):
    rows = pages()
    docs = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_archives(docs, frame_bytes=2000, bundle_bytes=20_000)
    back = warc.read_archives(manifest).collect()
    assert len(back) == len(rows) and len({r.record_id for r in back}) == len(rows)
    responses = {r.record_id: bytes(r.payload) for r in back if r.record_type == "response"}
    got = []
    for r in back:
        payload = responses[r.refers_to or r.record_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.payload is None) == (r.record_type == "revisit")
        got.append(payload)
    assert sorted(got) == sorted((h or "").encode() for _, _, h, _ in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in warc.page_records(docs).collect()}
    assert kinds >= {(9, "response", None), (9, "revisit", 9), (1, "revisit", 9), (None, "revisit", 9), (7, "response", None)}
    assert warc.page_records(spark.createDataFrame([], PAGES)).count() == 0


def test_bundles_are_plain_zstandard_and_seekable(spark):
    manifest = warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1), frame_bytes=2000)
    (uri,) = {r.bundle for r in manifest.collect()}
    fs, path = warc.filesystem(uri)
    with fs.open_input_file(path) as f:
        table = warc.seek_table(f)
        data = f.read_at(f.size(), 0)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(table) > 3 and len(whole) == sum(plain for _, _, plain in table)
    assert whole.count(b"WARC-Record-ID: <urn:") == len(pages())


def test_a_damaged_bundle_fails(spark):
    manifest = warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1))
    uri = manifest.first().bundle
    fs, path = warc.filesystem(uri)
    with fs.open_input_file(path) as f:
        data = bytearray(f.read_at(f.size(), 0))
    data[40] ^= 0xFF
    with pafs.LocalFileSystem().open_output_stream(path, compression=None) as f:
        f.write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017, PT011 - whichever layer sees it first
        warc.read_archives(manifest).collect()


def test_page_ids_of_any_text(spark):
    ids = ["null", None, "*", "a:b c+%2A", "", "é"]
    rows = [(i, "u", f"page {n}" * 200, "f") for n, i in enumerate(ids)]
    got = warc.page_records(spark.createDataFrame(rows, PAGES.replace("page_id long", "page_id string"))).collect()
    assert sorted(r.page_id or str(r.page_id) for r in got) == sorted(i or str(i) for i in ids)
