"""DuckDB SQL that the results are checked against, as common table
expressions that the catalog combines.
"""

from __future__ import annotations

from spanguard.plans.derived import DETECT_SHARE, LLM_SHARE, plant
from spanguard.schema import CATEGORY_OF, DEFAULT_RULES, ENTITIES, PATTERNS, POLICY_ID

LUHN = (
    "length({d}) = 16 and list_sum(list_transform(range(0, 16), lambda i:"
    " case when i % 2 = 0 then cast(substr({d}, 16 - i, 1) as int)"
    " when cast(substr({d}, 16 - i, 1) as int) * 2 > 9"
    " then cast(substr({d}, 16 - i, 1) as int) * 2 - 9"
    " else cast(substr({d}, 16 - i, 1) as int) * 2 end)) % 10 = 0"
)


def luhn(text: str) -> str:
    return "(" + LUHN.format(d=f"regexp_replace({text}, '[^0-9]', '', 'g')") + ")"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


ENTITY_DIM = (
    f"entity(entity_type, category, token) as (values {values(ENTITIES)})"
)
RULES = f"rule(entity_type, action, min_confidence) as (values {values(DEFAULT_RULES)})"
PRIORITY = "case detector when 'semantic' then 3 when 'presidio' then 2 else 1 end"

DOCS = f"docs as (select doc_id as k, concat(text, {plant('doc_id')}) as text from documents)"
ANSWERS = (
    "answers as (select doc_id as k, concat('on ', lang, ' ', source,"
    f" {plant('doc_id + 3')}) as text from documents)"
)
MESSAGES = (
    "messages as (select conv_id * 1000 + turn as k, conv_id, turn, role,"
    f" concat(text, {plant('conv_id + turn')}) as text from conversations where role <> 'assistant')"
)
CHOICES = (
    "choices as (select conv_id * 1000 + turn as k, conv_id, turn,"
    f" concat(text, {plant('conv_id * 3 + turn')}) as text from conversations where role = 'assistant')"
)


def raw(src: str, name: str = "raw") -> str:
    """Matches of all patterns over `src`(k, text)."""
    parts = []
    for n, (entity_type, pattern, confidence) in enumerate(PATTERNS):
        marked = f"regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g')"
        parts.append(
            f"select k, {n} as pno, '{entity_type}' as entity_type, {confidence}::double as confidence,"
            f" string_split({marked}, chr(1)) as ps from {src}"
        )
    union = " union all ".join(parts)
    return (
        f"{name}_p as (select k, pno, entity_type, confidence, unnest(ps) as piece,"
        f" generate_subscripts(ps, 1) as i from ({union}) where len(ps) > 1),"
        f" {name}_o as (select *, sum(length(piece)) over"
        " (partition by k, pno order by i rows unbounded preceding) as e"
        f" from {name}_p),"
        f" {name} as (select k, pno, entity_type, confidence, cast(e - length(piece) as bigint) as s,"
        f" cast(e as bigint) as e, piece as txt, 'regex' as detector from {name}_o"
        f" where i % 2 = 0 and (entity_type <> 'CREDIT_CARD' or {luhn('piece')}))"
    )


def merged(src: str, name: str = "merged") -> str:
    """Overlaps resolved over `src`(k, pno, entity_type, confidence, s, e, txt, detector)."""
    return (
        f"{name}_l as (select k, list({{'entity_type': entity_type, 'confidence': confidence,"
        f" 's': s, 'e': e, 'txt': txt, 'detector': detector, 'prio': {PRIORITY}}}"
        f" order by s, confidence desc, {PRIORITY} desc, pno) as l from {src} group by k),"
        f" {name}_u as (select k, unnest(list_reduce(list_transform(l, lambda f: [f]), lambda acc, x:"
        " case when x[1].s < acc[-1].e then case when x[1].confidence > acc[-1].confidence or"
        " (x[1].confidence = acc[-1].confidence and x[1].prio > acc[-1].prio)"
        " then list_concat(acc[1:len(acc) - 1], x) else acc end else list_concat(acc, x) end)) as f"
        f" from {name}_l),"
        f" {name} as (select k, f.entity_type, f.confidence, f.s, f.e, f.txt, f.detector from {name}_u)"
    )


def actionable(src: str, name: str = "acts", is_output: bool = False, rule: str = "rule") -> str:
    action = "case when r.action = 'BLOCK' then 'MASK' else r.action end" if is_output else "r.action"
    return (
        f"{name} as (select m.*, {action} as action from {src} m join {rule} r"
        " on r.entity_type = m.entity_type where m.confidence >= r.min_confidence)"
    )


RANK = "case action when 'BLOCK' then 3 when 'MASK' then 2 else 1 end"


def action_of(rank: str) -> str:
    return f"case coalesce({rank}, 1) when 3 then 'BLOCK' when 2 then 'MASK' else 'ALLOW' end"


def decided(src: str, acts: str, name: str = "decided") -> str:
    return (
        f"{name} as (select t.k, {action_of('max(' + RANK + ')')} as decision,"
        " coalesce(string_agg(a.action || ': ' || a.entity_type || ' detected (confidence=' ||"
        " printf('%.2f', a.confidence) || ', detector=' || a.detector || ')', ' | ' order by a.s), '') as reasons"
        f" from {src} t left join {acts} a on a.k = t.k group by t.k)"
    )


def redacted(src: str, spans: str, name: str = "red") -> str:
    """Texts of `src`(k, text) with the spans replaced, and counts by type."""
    return (
        f"{name}_g as (select k, entity_type, s, e, coalesce(lag(e) over"
        f" (partition by k order by s), 0) as prev from {spans}),"
        f" {name}_b as (select g.k, string_agg(substr(t.text, g.prev + 1, g.s - g.prev) || d.token, ''"
        f" order by g.s) as body, max(g.e) as tail from {name}_g g join {src} t on t.k = g.k"
        " join entity d on d.entity_type = g.entity_type group by g.k),"
        f" {name}_c as (select k, string_agg(entity_type || '=' || n, ',' order by entity_type) as counts"
        f" from (select k, entity_type, count(*) as n from {spans} group by all) group by k),"
        f" {name} as (select t.k, coalesce(b.body || substr(t.text, b.tail + 1), t.text) as text,"
        f" coalesce(c.counts, '') as counts from {src} t left join {name}_b b on b.k = t.k"
        f" left join {name}_c c on c.k = t.k)"
    )


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


SCAN = [DOCS, ENTITY_DIM, RULES, raw("docs"), merged("raw"), actionable("merged"), decided("docs", "acts")]

# Both sides of a request per document, then one audit row per event.
SIDES = [
    *SCAN,
    redacted("docs", "merged"),
    ANSWERS,
    raw("answers", "oraw"),
    merged("oraw", "omerged"),
    actionable("omerged", "oacts", is_output=True),
    decided("answers", "oacts", "odecided"),
    redacted("answers", "oacts", "ored"),
    "side as (select d.k, d.decision as input_decision, d.reasons,"
    " case when d.decision <> 'BLOCK' then o.decision end as output_decision,"
    " case when d.decision <> 'ALLOW' then r.counts else '' end as input_redactions,"
    " case when d.decision <> 'BLOCK' then q.counts else '' end as output_redactions,"
    " '[user]: ' || case when d.decision <> 'ALLOW' then r.text else t.text end as prompt_redacted,"
    " case when d.decision <> 'BLOCK' then q.text end as response_redacted"
    " from decided d join red r on r.k = d.k join docs t on t.k = d.k"
    " join odecided o on o.k = d.k join ored q on q.k = d.k)",
    "in_counts as (select m.k, m.entity_type, count(*) as n from merged m"
    " join decided d on d.k = m.k where d.decision <> 'ALLOW' group by all)",
    "out_counts as (select a.k, a.entity_type, count(*) as n from oacts a"
    " join decided d on d.k = a.k where d.decision <> 'BLOCK' group by all)",
]
EVENT_COLUMNS = (
    "ts as created_at, cast(user_id as varchar) as user_id, 'model-' || event_type as model,"
    f" cast(floor(value * 10) as int) // {DETECT_SHARE} as detection_latency_ms,"
    f" cast(floor(value * 10) as int) // {LLM_SHARE} as any_llm_latency_ms,"
    " cast(floor(value * 10) as int) as total_latency_ms"
)
AUDIT = [
    *SIDES,
    "ev as (select cast(event_id as varchar) as request_id,"
    f" event_id % (select count(*) from documents) as k, {EVENT_COLUMNS} from events)",
    "audit as (select md5('audit|' || request_id) as id, ev.*, s.* exclude (k),"
    f" '{POLICY_ID}' as policy_id, sha256(s.prompt_redacted) as prompt_hash,"
    " case when s.input_decision <> 'BLOCK' then any_llm_latency_ms end as llm_latency_ms,"
    " case greatest(case s.input_decision when 'BLOCK' then 3 when 'MASK' then 2 else 1 end,"
    " case s.output_decision when 'BLOCK' then 3 when 'MASK' then 2 else 1 end)"
    " when 3 then 'block' when 2 then 'mask' else 'allow' end as effective"
    " from ev join side s on s.k = ev.k)",
]

STAMP = "'%Y-%m-%d %H:%M:%S'"


def stamp(ts: str) -> str:
    return f"strftime({ts}, {STAMP})"


def nearest(value: str, p: float) -> str:
    """Nearest-rank percentile of `value` as an aggregate over a group."""
    ordered = f"list({value} order by {value})"
    return f"{ordered}[cast(round_even({p} * (count({value}) - 1), 0) as int) + 1]"


CATEGORIES = values(sorted(CATEGORY_OF.items()))
