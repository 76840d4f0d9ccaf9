"""Registered queries: detection, merging, policy and redaction of texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanguard.functions import bio
from spanguard.functions.spans import (
    merge_overlaps,
    needs_semantic,
    redact,
    redaction_marks,
    redaction_pieces,
)
from spanguard.functions.text import luhn_valid, pattern_findings
from spanguard.operators import models, rules, scan as S
from spanguard.plans import derived as D
from spanguard.plans import oracle as O
from spanguard.plans.registry import big, counts_text, query
from spanguard.schema import CONTEXTUAL_LABELS, PATTERNS

FLAT = "cast(k as bigint) as doc_id, entity_type, s as start, e as \"end\", txt as matched_text, confidence"


def _flat(df, *keys):
    """Long findings with 64-bit offsets."""
    return df.select(
        *keys, "entity_type", *big("start", "end"), "matched_text", "confidence"
    )


def _register_patterns():
    for entity_type, _, _ in PATTERNS:
        name = f"find_{entity_type.lower()}"
        where = f"select {FLAT} from raw where entity_type = '{entity_type}'"

        @query(name, O.with_(O.DOCS, O.raw("docs")) + where)
        def run(spark, sf, entity_type=entity_type):
            found = S.find_pattern(D.planted(spark, sf), entity_type)
            return _flat(S.long_findings(found, "doc_id"), "doc_id")


_register_patterns()


@query("regex_findings", O.with_(O.DOCS, O.raw("docs")) + f"select {FLAT} from raw")
def regex_findings(spark, sf):
    found = S.detect(D.planted(spark, sf))
    return _flat(S.long_findings(found, "doc_id", column="raw_findings"), "doc_id")


# Every run of digits, blanks and dashes that has the length of a card number.
_CARDISH = r"[0-9](?:[ -]?[0-9]){15}"


@query(
    "luhn_valid",
    O.with_(
        O.DOCS,
        f"n as (select k, unnest(regexp_extract_all(text, '{_CARDISH}')) as number from docs)",
    )
    + f"select cast(k as bigint) as doc_id, number, {O.luhn('number')} as valid from n",
)
def luhn(spark, sf):
    numbers = F.regexp_extract_all("text", F.lit(f"({_CARDISH})"), 1)
    return (
        D.planted(spark, sf)
        .select("doc_id", F.explode_outer(numbers).alias("number"))
        .filter(F.col("number").isNotNull())
        .withColumn("valid", luhn_valid("number"))
    )


@query(
    "categorize",
    O.with_(O.DOCS, O.ENTITY_DIM, O.raw("docs"))
    + "select d.category, r.entity_type, count(*) as n from raw r"
    " join entity d on d.entity_type = r.entity_type group by all",
)
def categorize(spark, sf):
    found = S.long_findings(
        S.detect(D.planted(spark, sf)), "doc_id", column="raw_findings"
    )
    return found.groupBy("category", "entity_type").agg(F.count(F.lit(1)).alias("n"))


# --- model passes with small deterministic stand-ins for the models -----------

_NAME = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
_IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
_BADGE = r"\b[A-Z][0-9]{3,}\b"


def stub_recognizer():
    """Capitalised word pairs, IP addresses and a label nobody maps."""
    patterns = [
        ("PERSON", re.compile(_NAME, re.ASCII), 0.85),
        ("IP_ADDRESS", re.compile(_IP, re.ASCII), 0.6),
        ("BADGE", re.compile(_BADGE, re.ASCII), 0.4),
    ]
    return models.each(
        lambda text: [
            (label, m.start(), m.end(), score)
            for label, p, score in patterns
            for m in p.finditer(text)
        ]
    )


def _stub_raw(src: str) -> str:
    """Stand-in recogniser spans as SQL, in the shape of `oracle.raw`."""
    parts = []
    for n, (kind, pattern, score) in enumerate(
        [("PERSON_NAME", _NAME, 0.85), ("GENERIC_PII", _IP, 0.6), ("GENERIC_PII", _BADGE, 0.4)]
    ):
        parts.append(
            f"select k, {10 + n} as pno, '{kind}' as entity_type, {score}::double as confidence,"
            f" string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) as ps"
            f" from {src}"
        )
    return (
        "nraw_p as (select k, pno, entity_type, confidence, unnest(ps) as piece,"
        f" generate_subscripts(ps, 1) as i from ({' union all '.join(parts)}) where len(ps) > 1),"
        " nraw_o as (select *, sum(length(piece)) over (partition by k, pno order by i"
        " rows unbounded preceding) as e from nraw_p),"
        " nraw as (select k, pno, entity_type, confidence, cast(e - length(piece) as bigint) as s,"
        " cast(e as bigint) as e, piece as txt, 'presidio' as detector from nraw_o where i % 2 = 0)"
    )


@query(
    "contextual_findings",
    O.with_(O.DOCS, _stub_raw("docs")) + f"select {FLAT} from nraw",
)
def contextual_findings(spark, sf):
    found = models.recognize(D.planted(spark, sf), stub_recognizer)
    found = found.withColumn("findings", models.contextual_findings("text", "recognized.spans"))
    return _flat(S.long_findings(found, "doc_id"), "doc_id")


@query(
    "contextual_label_map",
    f"with m(label, entity_type) as (values {O.values(CONTEXTUAL_LABELS)}),"
    " l as (select case event_id % 11"
    + "".join(f" when {i} then '{label}'" for i, (label, _) in enumerate(CONTEXTUAL_LABELS))
    + " when 9 then 'LOCATION' else 'NRP' end as label from events)"
    " select l.label, coalesce(m.entity_type, 'GENERIC_PII') as entity_type, count(*) as n"
    " from l left join m on m.label = l.label group by all",
)
def contextual_label_map(spark, sf):
    labels = [label for label, _ in CONTEXTUAL_LABELS] + ["LOCATION", "NRP"]
    picked = F.get(F.array(*map(F.lit, labels)), (F.col("event_id") % 11).cast("int"))
    return (
        D.table(spark, sf, "events")
        .select(picked.alias("label"))
        .withColumn("entity_type", models.contextual_type(F.col("label")))
        .groupBy("label", "entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stub_scorer():
    """Logits for every word: long words look like secrets, words with digits
    like personal data; a second such word in a row continues the span.
    """
    word = re.compile(r"\S+")

    def score(text):
        out, before = [(0, 0, [9.0, 0.0, 0.0, 0.0, 0.0])], 0
        for m in word.finditer(text):
            kind = 1 if any("0" <= c <= "9" for c in m.group()) else 3 if len(m.group()) > 14 else 0
            label = kind + 1 if kind and before == kind else kind
            logits = [0.0] * 5
            logits[label] = 2.0 + min(len(m.group()), 40) / 16.0
            out.append((m.start(), m.end(), logits))
            before = kind
        return [*out, (0, 0, [9.0, 0.0, 0.0, 0.0, 0.0])]

    return models.each(score)


def short_scorer():
    """The same, but unable to read more than 128 words."""
    inner = stub_scorer()

    def score(texts):
        if any(len(t.split()) > 128 for t in texts):
            raise ValueError("a text has more than 128 words")
        return inner(texts)

    return score


def semantic_raw(src: str, name: str = "sraw") -> str:
    """Findings of the stand-in classifier over `src`(k, text) as SQL."""
    kind = "case when regexp_matches(piece, '[0-9]') then 1 when length(piece) > 14 then 3 else 0 end"
    x = "(2.0::double + least(length(piece), 40) / 16.0::double)"
    return (
        f"{name}_p as (select k, unnest(ps) as piece, generate_subscripts(ps, 1) as i from (select k,"
        f" string_split(regexp_replace(text, '[^\\s\x1c-\x1f\x85\\p{{Z}}]+', chr(1) || '\\0' || chr(1), 'g'), chr(1)) as ps from {src})),"
        f" {name}_w as (select k, piece, i, sum(length(piece)) over (partition by k order by i rows unbounded preceding) as e,"
        f" {kind} as kind, 1 / (1 + 4 * exp(-{x})) as prob from {name}_p),"
        f" {name}_b as (select *, case when kind is distinct from lag(kind) over (partition by k order by i) then 1 else 0 end as brk"
        f" from {name}_w where i % 2 = 0),"
        f" {name}_g as (select *, sum(brk) over (partition by k order by i rows unbounded preceding) as g from {name}_b),"
        f" {name}_s as (select k, case any_value(kind) when 1 then 'GENERIC_PII' else 'GENERIC_SECRET' end as entity_type,"
        " round(avg(prob), 4) as confidence, cast(min(e - length(piece)) as bigint) as s, cast(max(e) as bigint) as e"
        f" from {name}_g where kind > 0 group by k, g),"
        f" {name} as (select x.k, 20 as pno, entity_type, confidence, s, e, substr(t.text, s + 1, e - s) as txt,"
        f" 'semantic' as detector from {name}_s x join {src} t on t.k = x.k)"
    )


@query(
    "semantic_findings",
    O.with_(O.DOCS, semantic_raw("docs")) + f"select {FLAT} from sraw",
)
def semantic_findings(spark, sf):
    """With a classifier that takes at most 128 words at a time."""
    scored = models.score_tokens(D.planted(spark, sf), models.windowed(short_scorer, 128, 32))
    found = scored.withColumn("findings", models.semantic_findings("text", "scored.scores"))
    return _flat(S.long_findings(found, "doc_id"), "doc_id")


# Token scores from the embeddings: every five numbers are the logits of a token,
# the last of which may lack some; every fifth token, and the first one, has the
# offsets of a special.
_NO_LOGIT = -80.0


def embedding_scores(spark, sf):
    scores = F.expr(
        "transform(filter(sequence(0, size(embedding)), t -> t * 5 < size(embedding)), t -> named_struct("
        "'start', if(t % 5 = 0, 0, t * 4), 'end', if(t % 5 = 0, 0, t * 4 + 3),"
        " 'logits', transform(sequence(0, 4), i -> coalesce(cast(get(embedding, t * 5 + i) as double) * 8,"
        f" {_NO_LOGIT}D))))"
    )
    vectors = D.table(spark, sf, "embeddings").select("vec_id", "embedding")
    text = F.expr("repeat('0123456789', size(embedding))")
    return vectors.select("vec_id", text.alias("text"), scores.alias("scores"))


_TOKEN_SQL = [
    "tok as (select vec_id, embedding, unnest(range(0, (len(embedding) + 4) // 5)) as t from embeddings),"
    "logit as (select vec_id, t, list_transform(range(1, 6), lambda i:"
    f" coalesce(cast(embedding[t * 5 + i] as double) * 8, {_NO_LOGIT}::double)) as lg from tok),"
    "best as (select vec_id, t, list_max(lg) as top,"
    " list_position(lg, list_max(lg)) - 1 as label,"
    " 1.0 / list_sum(list_transform(lg, lambda x: exp(x - list_max(lg)))) as prob from logit),"
    "tag as (select *, case when t % 5 = 0 and t > 0 then 0 else label end as l,"
    " case when t % 5 = 0 then 0 else t * 4 end as s,"
    " case when t % 5 = 0 then 0 else t * 4 + 3 end as e from best),"
    "grp as (select *, sum(case when l in (2, 4) then 0 else 1 end) over"
    " (partition by vec_id order by t rows unbounded preceding) as g from tag),"
    "span as (select vec_id, g, min(t) as t0, max(t) as t1, arg_min(l, t) as first_l,"
    " arg_min(s, t) as s, arg_max(e, t) as e, avg(prob) as conf from grp group by vec_id, g)"
]


@query(
    "bio_decode",
    O.with_(*_TOKEN_SQL)
    + "select vec_id, case first_l when 1 then 'GENERIC_PII' else 'GENERIC_SECRET' end as entity_type,"
    " cast(s as bigint) as start, cast(e as bigint) as \"end\","
    " substr(repeat('0123456789', 1 + e // 10), s + 1, greatest(0, e - s)) as matched_text,"
    " round(conf, 4) as confidence from span where first_l in (1, 3)",
)
def bio_decode(spark, sf):
    found = embedding_scores(spark, sf).withColumn("findings", bio.bio_decode("text", "scores"))
    return _flat(S.long_findings(found, "vec_id"), "vec_id")


@query(
    "span_confidence",
    O.with_(*_TOKEN_SQL)
    + "select vec_id, round(avg(prob), 4) as confidence from best group by vec_id",
)
def span_confidence(spark, sf):
    probs = "transform(preds, t -> t.prob)"
    return (
        embedding_scores(spark, sf)
        .withColumn("preds", bio.token_predictions("scores"))
        .select("vec_id", bio.span_confidence(probs).alias("confidence"))
    )


@query(
    "semantic_label_map",
    "with l as (select case event_id % 3 when 0 then 'PII' when 1 then 'SECRET' else 'MISC' end as label"
    " from events) select label, case label when 'SECRET' then 'GENERIC_SECRET' else 'GENERIC_PII' end"
    " as entity_type, case label when 'SECRET' then 'SECRET' else 'PII' end as category,"
    " count(*) as n from l group by all",
)
def semantic_label_map(spark, sf):
    from spanguard.functions.spans import category_of

    labels = F.array(F.lit("PII"), F.lit("SECRET"), F.lit("MISC"))
    return (
        D.table(spark, sf, "events")
        .select(F.get(labels, (F.col("event_id") % 3).cast("int")).alias("label"))
        .withColumn("entity_type", bio.semantic_type("label"))
        .withColumn("category", category_of(F.col("entity_type")))
        .groupBy("label", "entity_type", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "needs_semantic",
    O.with_(O.DOCS, O.raw("docs"))
    + "select cast(d.k as bigint) as doc_id, count(r.k) = 0 as escalate from docs d"
    " left join raw r on r.k = d.k and r.confidence >= 0.85 group by d.k",
)
def escalate(spark, sf):
    return S.detect(D.planted(spark, sf)).select(
        "doc_id", needs_semantic("raw_findings").alias("escalate")
    )


_ALL_RAW = [
    O.DOCS,
    O.ENTITY_DIM,
    O.RULES,
    O.raw("docs"),
    _stub_raw("docs"),
    "both_raw as (select * from raw union all select * from nraw)",
]


@query(
    "merge_overlaps",
    O.with_(*_ALL_RAW, O.merged("both_raw")) + f"select {FLAT}, detector from merged",
)
def merge_query(spark, sf):
    """Merge of two passes that find overlapping spans."""
    found = S.detect(
        D.planted(spark, sf), detectors=[models.contextual_detector(stub_recognizer)]
    ).withColumn("findings", merge_overlaps("raw_findings"))
    flat = S.long_findings(found, "doc_id")
    return flat.select(
        "doc_id", "entity_type", *big("start", "end"), "matched_text", "confidence", "detector"
    )


def failing_recognizer():
    """Like the stand-in, but unable to read some texts."""
    inner = stub_recognizer()

    def recognise(texts):
        if any(t.endswith("@corp.example.com") for t in texts):
            raise ValueError("cannot read one of these texts")
        return inner(texts)

    return recognise


@query(
    "isolate_failures",
    O.with_(
        *_ALL_RAW[:-1],
        "kept as (select * from raw union all select n.* from nraw n join docs d on d.k = n.k"
        " where not ends_with(d.text, '@corp.example.com'))",
        O.merged("kept"),
    )
    + "select cast(d.k as bigint) as doc_id,"
    " cast(max(case when ends_with(d.text, '@corp.example.com') then 1 else 0 end) as bigint) as errors,"
    " count(m.k) as n_findings from docs d left join merged m on m.k = d.k group by d.k",
)
def isolate_failures(spark, sf):
    found = S.scan(
        D.planted(spark, sf), detectors=[models.contextual_detector(failing_recognizer)]
    )
    return found.select(
        "doc_id",
        F.col("detector_errors").cast("bigint").alias("errors"),
        F.size("findings").cast("bigint").alias("n_findings"),
    )


@query(
    "scan_all_passes",
    O.with_(
        *_ALL_RAW[:-1],
        "unsure as (select k, text from docs where k not in (select k from raw where confidence >= 0.85))",
        semantic_raw("unsure"),
        "all_raw as (select * from raw union all select * from nraw union all select * from sraw)",
        O.merged("all_raw"),
        O.actionable("merged"),
        O.decided("docs", "acts"),
        O.redacted("docs", "acts"),
    )
    + "select cast(d.k as bigint) as doc_id, d.decision, 'regex,presidio,semantic' as detectors_used,"
    " (select count(*) from merged m where m.k = d.k) as n_findings,"
    " (select count(*) from merged m where m.k = d.k and m.detector = 'semantic') as n_semantic,"
    " case when d.decision = 'ALLOW' then t.text else r.text end as redacted_text"
    " from decided d join docs t on t.k = d.k join red r on r.k = d.k",
)
def scan_all_passes(spark, sf):
    """All three passes with the short-circuit in front of the slow one."""
    found = S.scan(
        D.planted(spark, sf),
        detectors=[
            models.contextual_detector(stub_recognizer),
            models.semantic_detector(stub_scorer),
        ],
    )
    return found.select(
        "doc_id",
        "decision",
        F.array_join("detectors_used", ",").alias("detectors_used"),
        F.size("findings").cast("bigint").alias("n_findings"),
        F.size(F.filter("findings", lambda f: f["detector"] == "semantic"))
        .cast("bigint")
        .alias("n_semantic"),
        "redacted_text",
    )


# --- policy and redaction -----------------------------------------------------


@query(
    "scan",
    O.with_(*O.SCAN, O.redacted("docs", "acts"))
    + "select cast(d.k as bigint) as doc_id, d.decision, d.reasons,"
    " case when d.decision = 'ALLOW' then t.text else r.text end as redacted_text,"
    " case when d.decision = 'ALLOW' then '' else r.counts end as counts,"
    " (select count(*) from merged m where m.k = d.k) as n_findings"
    " from decided d join docs t on t.k = d.k join red r on r.k = d.k",
)
def scan_query(spark, sf):
    return D.scanned(spark, sf).select(
        "doc_id",
        "decision",
        F.array_join("reasons", " | ").alias("reasons"),
        "redacted_text",
        counts_text("redaction_counts").alias("counts"),
        F.size("findings").cast("bigint").alias("n_findings"),
    )


# A live rule table with duplicates, disabled rows and an ALLOW rule. The
# second copy of a rule is newer for half of the types.
def live_rules(spark):
    base = rules.default_rules(spark)
    order = F.length("entity_type")
    copy = base.select(
        F.md5(F.concat(F.lit("copy|"), "entity_type")).alias("id"),
        F.concat("entity_type", F.lit(" override")).alias("name"),
        "description",
        "entity_type",
        "category",
        F.when(F.col("entity_type") == "PHONE", "ALLOW")
        .when(F.col("category") == "PII", "BLOCK")
        .otherwise("MASK")
        .alias("action"),
        F.least(F.lit(1.0), F.col("min_confidence") + 0.1).alias("min_confidence"),
        (order % 3 != 0).alias("enabled"),
        "created_at",
        F.when(order % 2 == 1, F.expr("created_at + interval 1 day"))
        .otherwise(F.expr("created_at - interval 1 day"))
        .alias("updated_at"),
    )
    return base.unionByName(copy)


LIVE = (
    "base(entity_type, action, min_confidence, category) as (select r.*, e.category from rule r"
    " join entity e on e.entity_type = r.entity_type),"
    "live as (select md5('rule|' || entity_type) as id, entity_type || ' default' as name, entity_type,"
    " category, action, min_confidence::double as min_confidence, true as enabled,"
    " timestamp '2024-01-01' as created_at, timestamp '2024-01-01' as updated_at from base"
    " union all select md5('copy|' || entity_type), entity_type || ' override', entity_type, category,"
    " case when entity_type = 'PHONE' then 'ALLOW' when category = 'PII' then 'BLOCK' else 'MASK' end,"
    " least(1.0::double, min_confidence::double + 0.1::double), length(entity_type) % 3 <> 0,"
    " timestamp '2024-01-01', case when length(entity_type) % 2 = 1 then timestamp '2024-01-02'"
    " else timestamp '2023-12-31' end from base),"
    "resolved as (select entity_type, arg_max(action, updated_at) as action,"
    " arg_max(min_confidence, updated_at) as min_confidence from live where enabled group by entity_type)"
)

_LIVE_SCAN = [
    O.DOCS,
    O.ENTITY_DIM,
    O.RULES,
    LIVE,
    O.raw("docs"),
    O.merged("raw"),
]


@query(
    "resolve_rules",
    O.with_(*_LIVE_SCAN, O.actionable("merged", rule="resolved"))
    + "select r.entity_type, r.action, round(r.min_confidence, 4) as min_confidence,"
    " (select count(*) from acts a where a.entity_type = r.entity_type) as n_applied from resolved r",
)
def resolve_rules(spark, sf):
    """Resolved rules and how many findings of the documents each applies to."""
    policy = rules.Policy(rules=live_rules(spark))
    acts = S.long_findings(
        S.scan(D.planted(spark, sf), policy), "doc_id", column="actionable"
    )
    applied = acts.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_applied"))
    return (
        rules.resolve_rules(live_rules(spark))
        .join(applied, "entity_type", "left")
        .select(
            "entity_type",
            "action",
            F.round("min_confidence", 4).alias("min_confidence"),
            F.coalesce("n_applied", F.lit(0)).alias("n_applied"),
        )
    )


@query(
    "apply_rules",
    O.with_(*_LIVE_SCAN, O.actionable("merged", rule="resolved"))
    + f"select {FLAT}, action from acts",
)
def apply_rules(spark, sf):
    policy = rules.Policy(rules=live_rules(spark))
    acts = S.long_findings(S.scan(D.planted(spark, sf), policy), "doc_id", column="actionable")
    return acts.select(
        "doc_id", "entity_type", *big("start", "end"), "matched_text", "confidence", "action"
    )


@query(
    "decide",
    O.with_(*_LIVE_SCAN, O.actionable("merged", rule="resolved"), O.decided("docs", "acts"))
    + "select cast(k as bigint) as doc_id, decision from decided",
)
def decide(spark, sf):
    policy = rules.Policy(rules=live_rules(spark))
    return S.scan(D.planted(spark, sf), policy).select("doc_id", "decision")


@query(
    "reasons",
    O.with_(*_ALL_RAW, O.merged("both_raw"), O.actionable("merged"), O.decided("docs", "acts"))
    + "select cast(k as bigint) as doc_id, reasons from decided where reasons <> ''",
)
def reasons(spark, sf):
    found = S.scan(
        D.planted(spark, sf), detectors=[models.contextual_detector(stub_recognizer)]
    )
    joined = F.array_join("reasons", " | ").alias("reasons")
    return found.select("doc_id", joined).filter(F.col("reasons") != "")


@query(
    "output_override",
    O.with_(
        *O.SCAN[:-2],
        O.actionable("merged", "on_acts", is_output=True),
        O.decided("docs", "on_acts", "on_d"),
        O.actionable("merged", "off_acts"),
        O.decided("docs", "off_acts", "off_d"),
    )
    + "select a.decision as scanning_on, b.decision as scanning_off, count(*) as n"
    " from on_d a join off_d b on b.k = a.k group by all",
)
def output_override(spark, sf):
    """Output decisions with output scanning on and off, from one detection."""
    on = S.scan(D.planted(spark, sf), is_output=True)
    on = on.withColumn("scanning_on", F.col("decision")).select("doc_id", "text", "findings", "scanning_on")
    off = S.evaluate(on, rules.Policy(output_scanning=False), is_output=True)
    return (
        off.withColumnRenamed("decision", "scanning_off")
        .groupBy("scanning_on", "scanning_off")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "redact",
    O.with_(O.DOCS, O.ENTITY_DIM, O.raw("docs"), O.merged("raw"), O.redacted("docs", "merged"))
    + "select cast(k as bigint) as doc_id, text as redacted_text from red",
)
def redact_query(spark, sf):
    """All findings redacted, whatever the policy says."""
    return D.scanned(spark, sf).select("doc_id", redact("text", "findings").alias("redacted_text"))


@query(
    "redaction_counts",
    O.with_(O.DOCS, O.ENTITY_DIM, O.raw("docs"), O.merged("raw"), O.redacted("docs", "merged"))
    + "select cast(k as bigint) as doc_id, counts from red",
)
def redaction_counts_query(spark, sf):
    from spanguard.functions.spans import redaction_counts

    counted = D.scanned(spark, sf).withColumn("c", redaction_counts("findings"))
    return counted.select("doc_id", counts_text("c").alias("counts"))


@query(
    "redaction_marks",
    O.with_(
        *O.SCAN,
        O.redacted("docs", "acts"),
        "tok as (select unnest(regexp_extract_all(text, '\\[REDACTED_\\w*\\]')) as token from red)",
    )
    + "select token, case when token = '[REDACTED_SECRET]' then 'SECRET' else 'PII' end as category,"
    " count(*) as n from tok group by all",
)
def marks(spark, sf):
    tokens = D.scanned(spark, sf).select(
        F.explode_outer(redaction_marks("redacted_text")).alias("t")
    )
    return (
        tokens.filter(F.col("t.token").isNotNull())
        .groupBy("t.token", "t.category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "redaction_pieces",
    O.with_(
        *O.SCAN,
        O.redacted("docs", "acts"),
        "cut as (select k, string_split(regexp_replace(text, '(\\[REDACTED_\\w*\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as ps"
        " from red)",
        "piece as (select k, unnest(ps) as text, generate_subscripts(ps, 1) as i from cut)",
    )
    + "select cast(k as bigint) as doc_id, row_number() over (partition by k order by i) - 1 as idx, text,"
    " case when i % 2 = 1 then null when text = '[REDACTED_SECRET]' then 'SECRET' else 'PII' end as category"
    " from piece where text <> ''",
)
def pieces(spark, sf):
    """Redacted documents as plain pieces and tokens in reading order."""
    cut = D.scanned(spark, sf).select("doc_id", F.posexplode(redaction_pieces("redacted_text")).alias("idx", "p"))
    return cut.select("doc_id", *big("idx"), "p.text", "p.category")


_TICKET = "[a-z]{3,}ing [0-9a-z]{2,}"


@query(
    "own_detector",
    O.with_(
        O.DOCS,
        O.ENTITY_DIM,
        O.raw("docs"),
        "own_p as (select k, unnest(ps) as piece, generate_subscripts(ps, 1) as i from (select k,"
        f" string_split(regexp_replace(text, '({_TICKET})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as ps from docs)),"
        " own_o as (select *, sum(length(piece)) over (partition by k order by i rows unbounded preceding) as e from own_p),"
        " own as (select k, 40 as pno, 'GENERIC_SECRET' as entity_type, 0.85::double as confidence,"
        " cast(e - length(piece) as bigint) as s, cast(e as bigint) as e, piece as txt, 'tickets' as detector"
        " from own_o where i % 2 = 0)",
        "all_raw as (select * from raw union all select * from own)",
        O.merged("all_raw").replace("else 1 end", "when 'tickets' then 5 else 1 end"),
    )
    + f"select {FLAT}, detector from merged",
)
def own_detector(spark, sf):
    """A pass of the user's own, registered with a priority above all others."""

    def tickets(text):
        return pattern_findings(text, _TICKET, "GENERIC_SECRET", "SECRET", 0.85, "tickets")

    found = S.scan(D.planted(spark, sf), detectors=[models.column_detector("tickets", 5, tickets)])
    flat = S.long_findings(found, "doc_id")
    return flat.select(
        "doc_id", "entity_type", *big("start", "end"), "matched_text", "confidence", "detector"
    )


@query(
    "reported_confidence",
    O.with_(*_ALL_RAW, O.merged("both_raw"))
    + "select detector, entity_type, round(confidence, 3) as confidence, count(*) as n"
    " from merged group by all",
)
def reported_confidence(spark, sf):
    found = S.scan(
        D.planted(spark, sf), detectors=[models.contextual_detector(stub_recognizer)]
    ).withColumn("reported", S.reported())
    flat = S.long_findings(found, "doc_id", column="reported")
    return flat.groupBy("detector", "entity_type", "confidence").agg(
        F.count(F.lit(1)).alias("n")
    )


def candidate_rule(spark):
    """Block e-mail addresses: a rule somebody is about to save, not enabled."""
    return rules.rules_frame(spark, [("EMAIL", "BLOCK", 0.9)]).withColumn("enabled", F.lit(False))


@query(
    "dry_run",
    O.with_(
        *_LIVE_SCAN,
        O.actionable("merged", "base_acts", rule="resolved"),
        O.decided("docs", "base_acts", "base_d"),
        "trial as (select entity_type, action, min_confidence from resolved where entity_type <> 'EMAIL'"
        " union all select 'EMAIL', 'BLOCK', 0.9::double)",
        O.actionable("merged", "acts", rule="trial"),
        O.decided("docs", "acts"),
        O.redacted("docs", "acts"),
    )
    + "select cast(d.k as bigint) as doc_id, b.decision as baseline, d.decision,"
    " b.decision <> d.decision as changed, d.reasons,"
    " case when d.decision = 'ALLOW' then t.text else r.text end as redacted_text"
    " from decided d join base_d b on b.k = d.k join docs t on t.k = d.k join red r on r.k = d.k",
)
def dry_run(spark, sf):
    trial = S.dry_run(D.planted(spark, sf), live_rules(spark), candidate_rule(spark))
    return trial.select(
        "doc_id",
        "baseline",
        "decision",
        "changed",
        F.array_join("reasons", " | ").alias("reasons"),
        "redacted_text",
    )


@query(
    "detections_by_decision",
    O.with_(*O.SCAN)
    + "select d.decision, coalesce(m.entity_type, 'NONE') as entity_type, count(*) as n"
    " from decided d left join merged m on m.k = d.k group by all",
)
def detections_by_decision(spark, sf):
    """The flagship: scan, then counts per decision and entity type."""
    found = D.scanned(spark, sf).select("decision", F.explode_outer("findings").alias("f"))
    return found.groupBy(
        "decision", F.coalesce("f.entity_type", F.lit("NONE")).alias("entity_type")
    ).agg(F.count(F.lit(1)).alias("n"))


