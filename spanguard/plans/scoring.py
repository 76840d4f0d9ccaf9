"""Registered queries: labelled examples, BIO rows, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanguard.functions import bio
from spanguard.operators import dataset as G
from spanguard.operators import evaluate as E
from spanguard.operators import models
from spanguard.plans import derived as D
from spanguard.plans import oracle as O
from spanguard.plans.detection import _TOKEN_SQL, embedding_scores, semantic_raw, stub_scorer
from spanguard.plans.registry import big, query
from spanguard.session import shared_dir
from spanguard.sources import tables

# --- synthesis ------------------------------------------------------------------


def _pick(salt: str, n: int) -> str:
    return f"(('0x' || substr(md5(key || '|{salt}'), 1, 8))::bigint % {n})"


def _item(salt: str, items) -> str:
    return f"([{', '.join(repr(i) for i in items)}])[{_pick(salt, len(items))} + 1]"


def _words(digits: str) -> str:
    names = ", ".join(repr(w) for w in G.DIGIT_WORDS)
    return (
        f"list_aggregate(list_transform(string_split(cast({digits} as varchar), ''),"
        f" lambda d: ([{names}])[cast(d as int) + 1]), 'string_agg', ' ')"
    )


def _num(salt: str, low: int, high: int) -> str:
    return f"({low} + {_pick(salt, high - low + 1)})"


_VALUES = {
    "email": f"{_item('first', G.FIRST)} || ' dot ' || {_item('last', G.LAST)} || ' at ' ||"
    f" {_item('domain', G.DOMAINS)} || ' dot ' || {_item('tld', G.TLDS)}",
    "phone": f"{_words(_num('a', 200, 999))} || ' ' || {_words(_num('b', 100, 999))} || ' ' ||"
    f" {_words(_num('c', 1000, 9999))}",
    "ssn": f"{_words(_num('a', 100, 999))} || ' dash ' || {_words(_num('b', 10, 99))} || ' dash ' ||"
    f" {_words(_num('c', 1000, 9999))}",
    "password": f"{_item('last', G.LAST)} || {_num('c', 10, 9999)}",
    "api_key": f"{_item('prefix', G.KEY_PREFIXES)} || substr(md5(key || '|key'), 1, 20)",
    "card": _words(_num("card", 1000, 9999)),
    "implied": _item("implied", G.IMPLIED),
}


def _synthetic() -> str:
    bound, families, values, templates = 0, [], [], []
    for family, n in G.FAMILIES:
        bound += n
        families.append(f"when r < {bound} then '{family}'")
        values.append(f"when '{family}' then {_VALUES[family]}")
        mine = [t for t in G.TEMPLATES if t[0] == family]
        templates.append(f"when '{family}' then {_pick('template', len(mine))}")
    rows = []
    seen: dict[str, int] = {}
    for family, label, pre, post in G.TEMPLATES:
        rows.append((family, seen.get(family, 0), label, pre, post))
        seen[family] = seen.get(family, 0) + 1
    total = sum(n for _, n in G.FAMILIES)
    return (
        f"tpl(family, i, label, pre, post) as (values {O.values(rows)}),"
        f"fam as (select doc_id, key, case {' '.join(families)} end as family from"
        f" (select doc_id, key, {_pick('family', total)} as r from"
        " (select doc_id, doc_id || '|42' as key from documents))),"
        f"val as (select doc_id, key, family, case family {' '.join(values)} end as v,"
        f" case family {' '.join(templates)} end as i from fam),"
        "syn as (select doc_id, val.family, pre || v || post as text, length(pre) as s,"
        " length(pre) + length(v) as e, label from val join tpl on tpl.family = val.family and tpl.i = val.i)"
    )


def synthetic(spark, sf):
    return G.synthesize(D.table(spark, sf, "documents").select("doc_id"), "doc_id")


def negatives(spark, sf):
    return G.hard_negatives(D.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "synthesize",
    O.with_(_synthetic())
    + 'select doc_id, family, text, cast(s as bigint) as start, cast(e as bigint) as "end", label from syn',
)
def synthesize(spark, sf):
    rows = synthetic(spark, sf).select("doc_id", "family", "text", F.inline("entities"))
    return rows.select("doc_id", "family", "text", *big("start", "end"), "label")


@query(
    "digits_to_words",
    "with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9][0-9-]*')) as digits from documents)"
    f" select doc_id, digits, {_words('regexp_replace(digits, ' + repr('[^0-9]') + ', ' + repr('') + ', ' + repr('g') + ')')} as words from n",
)
def digits_to_words(spark, sf):
    runs = F.regexp_extract_all("text", F.lit("([0-9][0-9-]*)"), 1)
    docs = D.table(spark, sf, "documents").select("doc_id", F.explode(runs).alias("digits"))
    return docs.withColumn("words", G.digits_to_words("digits"))


@query(
    "verify_spans",
    O.with_(_synthetic())
    + "select family, trim(substr(text, s + 1, e - s)) <> '' as valid, count(*) as n from syn group by all",
)
def verify_spans(spark, sf):
    checked = synthetic(spark, sf).withColumn("valid", G.verify_spans())
    return checked.groupBy("family", "valid").agg(F.count("*").alias("n"))


_NEGATIVE = f"select doc_id, {_item('negative', G.NEGATIVES)} as text from (select doc_id, doc_id || '|42' as key from documents)"


@query("hard_negatives", _NEGATIVE)
def hard_negatives(spark, sf):
    return negatives(spark, sf).select("doc_id", "text")


@query("cap_negatives", f"{_NEGATIVE} order by doc_id limit 80")
def cap_negatives(spark, sf):
    return G.cap_negatives(negatives(spark, sf), 80, "doc_id").select("doc_id", "text")


@query(
    "merge_sources",
    O.with_(_synthetic())
    + "select 'synthetic' as source, count(*) as n, count(*) as n_entities from syn union all"
    f" select 'hard_negative', count(*), 0 from ({_NEGATIVE} order by doc_id limit 80)",
)
def merge_sources(spark, sf):
    mixed = G.merge_sources(
        {
            "synthetic": synthetic(spark, sf),
            "hard_negative": G.cap_negatives(negatives(spark, sf), 80, "doc_id"),
        }
    )
    return mixed.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.size("entities")).alias("n_entities")
    )


@query(
    "read_labeled",
    O.with_(_synthetic()) + "select text, label, count(*) as n from syn group by all",
)
def read_labeled(spark, sf):
    """Examples written as JSON lines and read back."""
    path = shared_dir(spark, "labeled")
    synthetic(spark, sf).select("text", "entities").write.json(path)
    rows = tables.read_labeled(spark, path).select("text", F.inline("entities"))
    return rows.groupBy("text", "label").agg(F.count("*").alias("n"))


# --- BIO ------------------------------------------------------------------------


def labeled_documents(spark, sf):
    """Documents as they are given, with their findings as entities."""
    found = D.scan(D.planted(spark, sf))
    entities = F.transform(
        "findings",
        lambda f: F.struct(
            f["start"].alias("start"), f["end"].alias("end"), f["category"].alias("label")
        ),
    )
    return found.select("doc_id", "text", entities.alias("entities"))


def materialized(*names: str) -> list[str]:
    """Tables that are read more than once, or again in each step of a recursion."""
    return [f"{n}_m as materialized (select * from {n})" for n in names]


# A tag is that of the character reached by adding up token lengths and skipping blanks, so each
# place follows from the one before; texts without findings need no places.
_SKIP = "{p} + coalesce(blanks[{p} + 1], 0)"
_BIO = [
    O.DOCS,
    O.ENTITY_DIM,
    O.raw("docs"),
    O.merged("raw"),
    "spans as materialized (select * from merged)",
    "toks as materialized (select k, text, list_filter(string_split_regex(text, '[\\x09-\\x0d\\x1c-\\x1f\\x{85}\\p{Z}]+'),"
    " lambda t: t <> '') as t from docs)",
    "found as materialized (select * from toks where k in (select k from spans) and len(t) > 0)",
    "skips as materialized (select k, t, flatten(list_transform(regexp_extract_all(text, ' +|[^ ]+'), lambda r:"
    " case when r[1] = ' ' then range(length(r), 0, -1) else list_resize([0::bigint], length(r), 0) end)) as blanks from found)",
    f"walk as (select k, t, list_reduce(list_prepend([{_SKIP.format(p='0')}], list_transform(t[:-2], lambda x: [length(x)])),"
    f" lambda ps, x: list_append(ps, {_SKIP.format(p='(ps[-1] + x[1])')})) as ps from skips)",
    "place as (select k, unnest(range(1, len(t) + 1)) as i, unnest(ps) as p from walk)",
    "hit as materialized (select w.k, w.i, any_value(case when w.p = m.s then 'B-' else 'I-' end || d.category) as tag"
    " from place w join spans m on m.k = w.k and m.s <= w.p and w.p < m.e"
    " join entity d on d.entity_type = m.entity_type group by w.k, w.i)",
    "bio as materialized (select tag from hit union all select 'O' from (select unnest(range(n)) from"
    " (select (select sum(len(t)) from toks)::bigint - (select count(*) from hit) as n)))",
]


@query(
    "text_to_bio",
    O.with_(*_BIO) + "select cast(k as bigint) as doc_id, cast(i - 1 as bigint) as idx, t[i] as token, tag from hit join found using (k)",
)
def text_to_bio(spark, sf):
    rows = G.bio_rows(labeled_documents(spark, sf), "doc_id")
    tagged = rows.select("doc_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("idx", "t"))
    return tagged.select("doc_id", *big("idx"), "t.tokens", "t.tags").toDF(
        "doc_id", "idx", "token", "tag"
    ).filter(F.col("tag") != "O")


@query(
    "encode_labels",
    O.with_(*_BIO)
    + "select cast(list_position(['O', 'B-PII', 'I-PII', 'B-SECRET', 'I-SECRET'], tag) - 1 as bigint) as label,"
    " count(*) as n from bio group by all",
)
def encode_labels(spark, sf):
    rows = G.bio_rows(labeled_documents(spark, sf), "doc_id")
    return (
        rows.select(F.explode("labels").alias("label"))
        .groupBy(F.col("label").cast("bigint").alias("label"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "label_distribution",
    O.with_(*_BIO)
    + "select tag as label, count(*) as n, round(count(*) * 100.0::double / (select count(*) from bio), 1) as pct"
    " from bio group by tag",
)
def label_distribution(spark, sf):
    return E.label_distribution(G.bio_rows(labeled_documents(spark, sf), "doc_id"))


def label_pairs(spark, sf):
    """Two label sequences per embedding: the second is the best label of each
    token, the first differs in a fifth of the places and ignores some.
    """
    best = "transform(scores, t -> cast(array_position(t.logits, array_max(t.logits)) as int) - 1)"
    truth = (
        "transform(pred, (l, t) -> case when t % 6 = 0 then -100"
        " when (vec_id + t) % 5 = 0 then (l + 1) % 5 else l end)"
    )
    return (
        embedding_scores(spark, sf)
        .withColumn("pred", F.expr(best))
        .withColumn("true", F.expr(truth))
        .withColumn(
            "true", F.transform("true", lambda x: x.cast("int"))
        )
        .select("vec_id", "pred", "true")
    )


def _chunks(side: str) -> str:
    return (
        f"{side}_g as (select vec_id, t, {side} as l, case when {side} in (1, 2) then 'PII' when {side} in (3, 4)"
        f" then 'SECRET' end as kind, lag(case when {side} in (1, 2) then 'PII' when {side} in (3, 4) then 'SECRET' end)"
        f" over (partition by vec_id order by t) as before from kept),"
        f"{side}_s as (select *, sum(case when l = 0 or l in (1, 3) or kind is distinct from before then 1 else 0 end)"
        f" over (partition by vec_id order by t rows unbounded preceding) as g from {side}_g),"
        f"{side}_c as (select vec_id, any_value(kind) as label, min(t) as t0, max(t) as t1 from {side}_s"
        f" where l <> 0 group by vec_id, g)"
    )


_PAIRS = [
    *_TOKEN_SQL,
    "pair as (select vec_id, t, cast(label as int) as pred, case when t % 6 = 0 then -100"
    " when (vec_id + t) % 5 = 0 then (label + 1) % 5 else label end as truth from best)",
    "kept as (select * from pair where truth <> -100)",
]


_SCORE_SQL = (
    "round(coalesce(tp::double / nullif(tp + fp, 0), 0), 4) as precision,"
    " round(coalesce(tp::double / nullif(tp + fn, 0), 0), 4) as recall,"
    " round(coalesce(2 * coalesce(tp::double / nullif(tp + fp, 0), 0) * coalesce(tp::double / nullif(tp + fn, 0), 0) /"
    " nullif(coalesce(tp::double / nullif(tp + fp, 0), 0) + coalesce(tp::double / nullif(tp + fn, 0), 0), 0), 0), 4) as f1"
)


@query(
    "entity_prf",
    O.with_(
        *_PAIRS,
        _chunks("truth"),
        _chunks("pred"),
        "side as (select coalesce(a.label, b.label) as label, a.vec_id is not null as in_t, b.vec_id is not null as in_p"
        " from truth_c a full join pred_c b on a.vec_id = b.vec_id and a.label = b.label and a.t0 = b.t0 and a.t1 = b.t1)",
        "cnt as (select label, count(*) filter (in_t and in_p) as tp, count(*) filter (in_p and not in_t) as fp,"
        " count(*) filter (in_t and not in_p) as fn from side group by label),"
        " allc as (select * from cnt union all select 'micro', cast(sum(tp) as bigint), cast(sum(fp) as bigint),"
        " cast(sum(fn) as bigint) from cnt)",
    )
    + f"select label, tp, fp, fn, {_SCORE_SQL} from allc",
)
def entity_prf(spark, sf):
    return E.entity_prf(label_pairs(spark, sf))


@query(
    "align_subwords",
    O.with_(
        *_TOKEN_SQL,
        "pieces as (select vec_id, i, case when i in (0, n - 1) then null else (i - 1) * (7 + vec_id % 3) // 10 end as w"
        " from (select vec_id, n, unnest(range(0, n)) as i from"
        " (select vec_id, 2 * ((len(embedding) + 4) // 5) as n from embeddings))),"
        "al as (select p.vec_id, p.i, case when p.w is null then -100 when lag(p.w) over (partition by p.vec_id order by p.i) = p.w"
        " and b.label in (1, 3) then b.label + 1 else coalesce(b.label, 0) end as l from pieces p"
        " left join best b on b.vec_id = p.vec_id and b.t = p.w)",
    )
    + "select vec_id, string_agg(cast(l as varchar), ',' order by i) || repeat(',-100', greatest(0, 128 - count(*))) as labels from al group by vec_id",
)
def align_subwords(spark, sf):
    words = (
        "transform(sequence(0, 2 * size(pred) - 1), i -> if(i in (0, 2 * size(pred) - 1), null,"
        " cast((i - 1) * (7 + vec_id % 3) div 10 as int)))"
    )
    pairs = label_pairs(spark, sf).withColumn("words", F.expr(words))
    return pairs.select(
        "vec_id",
        F.array_join(bio.align_subwords("pred", "words").cast("array<string>"), ",").alias("labels"),
    )


# --- splits ---------------------------------------------------------------------

_SPLIT = (
    "ranked as (select doc_id, row_number() over (order by md5(doc_id || '|split|42'), doc_id) as r,"
    " count(*) over () as n from documents),"
    " split as (select doc_id, case when r <= ceil(0.5 * ceil(0.2::double * n)) then 'test'"
    " when r <= ceil(0.2::double * n) then 'validation' else 'train' end as split from ranked)"
)


@query("split_80_10_10", O.with_(_SPLIT) + "select doc_id, split from split")
def split_80_10_10(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id")
    return G.split_80_10_10(docs, "doc_id")


@query("write_splits", O.with_(_SPLIT) + "select split, count(*) as n from split group by split")
def write_splits(spark, sf):
    """Rows per folder of the written splits."""
    path = shared_dir(spark, "splits")
    tables.write_splits(split_80_10_10(spark, sf), path)
    rows = spark.read.schema("doc_id bigint, split string").parquet(path)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


# --- span scores ----------------------------------------------------------------


def gold_and_predicted(spark, sf):
    """Predictions are the findings of the planted documents. Gold spans are the
    same moved by up to two characters, some with the other category, some
    three times as long, and none for a fifth of the documents.
    """
    label = F.expr(
        "transform(findings, f -> struct(f.start + cast(doc_id % 3 as int) as start,"
        " f.end + cast(doc_id % 3 as int) + if(doc_id % 11 = 0, 2 * (f.end - f.start), 0) as end,"
        " if(doc_id % 7 = 0, if(f.category = 'PII', 'SECRET', 'PII'), f.category) as label))"
    )
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    pred = F.expr(
        "transform(findings, f -> struct(f.start as start, f.end as end, f.category as category,"
        " f.entity_type as entity_type))"
    )
    return D.scanned(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, none).otherwise(label).alias("gold"), pred.alias("pred")
    )


_MATCH = [
    O.DOCS,
    O.ENTITY_DIM,
    O.raw("docs"),
    O.merged("raw"),
    "pred as (select m.k, m.s, m.e, d.category, m.entity_type from merged m join entity d on d.entity_type = m.entity_type)",
    "gold as (select k, s + k % 3 as s, e + k % 3 + case when k % 11 = 0 then 2 * (e - s) else 0 end as e,"
    " case when k % 7 = 0 then case category when 'PII' then 'SECRET' else 'PII' end else category end as label"
    " from pred where k % 5 <> 0)",
    "pairs as (select g.k, g.s as gs, p.s as ps, g.label, p.category, p.entity_type from gold g join pred p on p.k = g.k"
    " and greatest(0, least(g.e, p.e) - greatest(g.s, p.s))::double / (greatest(g.e, p.e) - least(g.s, p.s)) >= 0.5)",
    "outc as (select k, label as gold, category as pred, case when label = category then entity_type end as pred_type from pairs"
    " union all select g.k, g.label, 'NONE', null from gold g left join pairs x on x.k = g.k and x.gs = g.s where x.k is null"
    " union all select p.k, 'NONE', p.category, null from pred p left join pairs x on x.k = p.k and x.ps = p.s where x.k is null"
    " union all select d.k, 'NONE', 'NONE', null from docs d where d.k not in (select k from pred) and d.k not in (select k from gold))",
]


def outcomes(spark, sf):
    return E.match_spans(gold_and_predicted(spark, sf), "doc_id")


@query(
    "match_spans",
    O.with_(*_MATCH)
    + "select cast(k as bigint) as doc_id, gold, pred, pred_type, count(*) as n from outc group by all",
)
def match_spans(spark, sf):
    found = outcomes(spark, sf)
    return found.groupBy("doc_id", "gold", "pred", "pred_type").agg(F.count("*").alias("n"))


@query(
    "confusion",
    O.with_(*_MATCH, "cat(c) as (values ('PII'), ('SECRET'), ('NONE'))")
    + "select a.c as gold, b.c as pred, (select count(*) from outc where gold = a.c and pred = b.c) as n"
    " from cat a, cat b",
)
def confusion(spark, sf):
    return E.confusion(outcomes(spark, sf))


_PRF = [
    *_MATCH,
    "cat(category) as (values ('PII'), ('SECRET'))",
    "cnt as (select category, (select count(*) from outc where gold = category and pred = category) as tp,"
    " (select count(*) from outc where pred = category and gold <> category) as fp,"
    " (select count(*) from outc where gold = category and pred <> category) as fn from cat),"
    " allc as (select * from cnt union all select 'micro', cast(sum(tp) as bigint), cast(sum(fp) as bigint),"
    " cast(sum(fn) as bigint) from cnt)",
]


@query("prf", O.with_(*_PRF) + f"select category, tp, fp, fn, {_SCORE_SQL} from allc")
def prf(spark, sf):
    return E.prf(outcomes(spark, sf))


@query("write_metrics", O.with_(*_PRF) + f"select category, tp, fp, fn, {_SCORE_SQL} from allc")
def write_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    scores = E.prf(outcomes(spark, sf))
    tables.write_metrics(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query(
    "tp_type_breakdown",
    O.with_(*_MATCH)
    + "select pred_type as entity_type, count(*) as n from outc where pred_type is not null group by all",
)
def tp_type_breakdown(spark, sf):
    return E.tp_type_breakdown(outcomes(spark, sf))


# --- parity ---------------------------------------------------------------------


def two_backends(spark, sf):
    """The same token scores from two backends; the second is off by a little
    for a tenth of the vectors and has two logits swapped for a few.
    """
    a = embedding_scores(spark, sf)
    off = (
        "transform(scores, (t, j) -> named_struct('start', t.start, 'end', t.end, 'logits',"
        " transform(t.logits, (x, i) -> case"
        " when vec_id % 50 = 7 and j = 3 and i < 2 then t.logits[1 - i]"
        " when vec_id % 10 = 3 then x + 0.00005D else x end)))"
    )
    b = a.withColumn("scores", F.expr(off))
    decode = bio.bio_decode("text", "scores")
    return a.withColumn("findings", decode), b.withColumn("findings", decode)


def _decoded(side: str) -> str:
    """The spans of a backend's logits (category, start, end), as one list per vector."""
    return (
        f"{side}_tag as (select vec_id, t, case when t % 5 = 0 and t > 0 then 0 else list_position({side}, list_max({side})) - 1 end as l,"
        f" case when t % 5 = 0 then 0 else t * 4 end as s, case when t % 5 = 0 then 0 else t * 4 + 3 end as e from ab),"
        f" {side}_grp as (select *, sum(case when l in (2, 4) then 0 else 1 end) over"
        f" (partition by vec_id order by t rows unbounded preceding) as g from {side}_tag),"
        f" {side}_span as (select vec_id, g, arg_min(l, t) as l, arg_min(s, t) as s, arg_max(e, t) as e from {side}_grp group by vec_id, g),"
        f" {side}_spans as (select vec_id, list(struct_pack(c := (l + 1) // 2, s := s, e := e) order by g) as spans"
        f" from {side}_span where l in (1, 3) group by vec_id)"
    )


_PARITY = [
    *_TOKEN_SQL,
    "ab as (select vec_id, t, lg as a, case when vec_id % 50 = 7 and t = 3 then [lg[2], lg[1], lg[3], lg[4], lg[5]]"
    " when vec_id % 10 = 3 then list_transform(lg, lambda x: x + 0.00005::double) else lg end as b from logit)",
    "cmp as (select vec_id, max(list_max(list_transform(range(1, 6), lambda i: abs(a[i] - b[i])))) as max_diff,"
    " bool_or(list_position(a, list_max(a)) <> list_position(b, list_max(b))) as argmax_differs from ab group by vec_id)",
    _decoded("a"),
    _decoded("b"),
    "both_sides as (select coalesce(x.vec_id, y.vec_id) as vec_id, x.spans is distinct from y.spans as spans_differ"
    " from a_spans x full join b_spans y on x.vec_id = y.vec_id)",
    "full_cmp as (select c.*, coalesce(s.spans_differ, false) as spans_differ from cmp c left join both_sides s on s.vec_id = c.vec_id)",
]


@query(
    "parity",
    O.with_(*_PARITY) + "select vec_id, round(max_diff, 9) as max_diff, argmax_differs, spans_differ from full_cmp",
)
def parity(spark, sf):
    compared = E.parity(*two_backends(spark, sf), "vec_id")
    return compared.select("vec_id", F.round("max_diff", 9).alias("max_diff"), "argmax_differs", "spans_differ")


@query(
    "parity_summary",
    O.with_(*_PARITY)
    + "select count(*) as examples, round(max(max_diff), 9) as max_diff, count(*) filter (argmax_differs) as argmax_mismatches,"
    " count(*) filter (spans_differ) as span_mismatches,"
    " max(max_diff) < 0.0001 and count(*) filter (argmax_differs) = 0 and count(*) filter (spans_differ) = 0"
    " as within_tolerance from full_cmp",
)
def parity_summary(spark, sf):
    summary = E.parity_summary(E.parity(*two_backends(spark, sf), "vec_id"))
    return summary.withColumn("max_diff", F.round("max_diff", 9))


_SYNTHETIC_MATCH = [
    _synthetic(),
    O.ENTITY_DIM,
    "src as (select doc_id as k, text from syn)",
    semantic_raw("src"),
    "pred as (select k, s, e, case entity_type when 'GENERIC_PII' then 'PII' else 'SECRET' end as category,"
    " entity_type from sraw)",
    "gold as (select doc_id as k, s, e, label from syn)",
    "docs as (select k from src)",
    *_MATCH[-2:],
]


@query(
    "model_eval",
    O.with_(*_SYNTHETIC_MATCH, *_PRF[-2:]) + f"select category, tp, fp, fn, {_SCORE_SQL} from allc",
)
def model_eval(spark, sf):
    """Scores of the stand-in classifier on the synthetic examples."""
    scored = models.score_tokens(synthetic(spark, sf), stub_scorer)
    found = scored.withColumn("findings", models.semantic_findings("text", "scored.scores"))
    pred = F.transform(
        "findings",
        lambda f: F.struct(
            *[f[n].alias(n) for n in ("start", "end", "category", "entity_type")]
        ),
    )
    pairs = found.select("doc_id", F.col("entities").alias("gold"), pred.alias("pred"))
    return E.prf(E.match_spans(pairs, "doc_id"))
