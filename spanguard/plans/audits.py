"""Registered queries: rules, requests, audit rows and metrics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from spanguard.functions.policy import effective_decision
from spanguard.operators import audit as A
from spanguard.operators import metrics as M
from spanguard.operators import requests as R
from spanguard.operators import rules
from spanguard.operators import scan as S
from spanguard.operators.paging import day_page, page_cursor
from spanguard.plans import derived as D
from spanguard.plans import oracle as O
from spanguard.plans.registry import big, counts_text, query, stamp_col
from spanguard.schema import CONFIDENCE_BOUNDS, LATENCY_BOUNDS
from spanguard.sources import tables
from spanguard.session import shared_dir

AS_OF_SQL = f"timestamp '{D.AS_OF}'"


def since(interval: str) -> str:
    return f"created_at >= {AS_OF_SQL} - interval {interval}"


# --- rules --------------------------------------------------------------------


@query(
    "default_rules",
    O.with_(*O.SCAN)
    + "select r.entity_type, e.category, r.action, r.min_confidence::double as min_confidence,"
    " (select count(*) from merged m where m.entity_type = r.entity_type) as n_findings"
    " from rule r join entity e on e.entity_type = r.entity_type",
)
def default_rules(spark, sf):
    """The seed rules and how often their type is found in the documents."""
    found = S.long_findings(D.scanned(spark, sf), "doc_id")
    counts = found.groupBy("entity_type").agg(F.count("*").alias("n_findings"))
    return (
        rules.default_rules(spark)
        .join(counts, "entity_type", "left")
        .select(
            "entity_type",
            "category",
            "action",
            "min_confidence",
            F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        )
    )


# A rule table of any size: one candidate rule per event, some of them invalid.
def event_rules(spark, sf):
    e = F.col("event_id")
    types = F.array(*[F.lit(t) for t in ("EMAIL", "SSN", "JWT", "PASSPORT", "PHONE")])
    actions = F.array(*[F.lit(a) for a in ("mask", "BLOCK", "allow", "drop")])
    return D.table(spark, sf, "events").select(
        F.md5(F.concat(F.lit("r|"), e.cast("string"))).alias("id"),
        F.when(e % 13 == 0, "").otherwise(F.concat(F.lit("rule "), e.cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.get(types, (e % 5).cast("int")).alias("entity_type"),
        F.lit(None).cast("string").alias("category"),
        F.get(actions, (e % 4).cast("int")).alias("action"),
        (F.col("value") / 100).alias("min_confidence"),
        (e % 3 != 0).alias("enabled"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


EVENT_RULES = (
    "er as (select md5('r|' || event_id) as id, case when event_id % 13 = 0 then '' else 'rule ' || event_id end as name,"
    " ['EMAIL', 'SSN', 'JWT', 'PASSPORT', 'PHONE'][event_id % 5 + 1] as entity_type,"
    " ['mask', 'BLOCK', 'allow', 'drop'][event_id % 4 + 1] as action, value / 100 as min_confidence,"
    " event_id % 3 <> 0 as enabled, ts as created_at, event_id from events)"
)


@query(
    "validate_rules",
    O.with_(EVENT_RULES)
    + "select id, concat_ws(',', case when length(name) < 1 then 'name' end,"
    " case when entity_type = 'PASSPORT' then 'entity_type' end,"
    " case when action = 'drop' then 'action' end,"
    " case when min_confidence < 0 or min_confidence > 1 then 'min_confidence' end) as errors from er",
)
def validate_rules(spark, sf):
    checked = rules.validate_rules(event_rules(spark, sf))
    return checked.select("id", F.array_join("errors", ",").alias("errors"))


@query(
    "list_rules",
    O.with_(EVENT_RULES)
    + f"select id, name, {O.stamp('created_at')} as created_at from er where enabled"
    " order by created_at desc, id desc limit 51 offset 50",
)
def list_rules(spark, sf):
    """Second page of the enabled rules."""
    table = event_rules(spark, sf)
    cursor = page_cursor(rules.list_rules(table, True, 50), 50)
    page = rules.list_rules(table, True, 50, cursor)
    return page.select("id", "name", stamp_col("created_at").alias("created_at"))


@query(
    "upsert_rules",
    O.with_(
        EVENT_RULES,
        "cat(entity_type, category) as (values " + O.CATEGORIES + ")",
        "ch as (select id, case event_id % 7 when 0 then 'patch' when 1 then 'delete' when 2 then 'create' end as op,"
        " event_id, case when event_id % 7 = 0 and event_id % 2 = 0 then 'JWT' end as new_type,"
        " case when event_id % 7 = 0 then 'block' end as new_action from er where event_id % 7 < 3)",
        "cr as (select md5('new|' || event_id) as id, 'new ' || event_id as name, 'EMAIL' as entity_type,"
        " 'PII' as category, 'MASK' as action, 0.5::double as min_confidence, event_id % 2 = 1 as enabled,"
        f" {AS_OF_SQL} as updated_at from ch where op = 'create'"
        " union all select id, 'again ' || event_id, 'EMAIL', 'PII', 'MASK', 0.5::double, true,"
        f" {AS_OF_SQL} from ch where op = 'delete' and event_id % 3 = 1)",
    )
    + "select id, name, entity_type, category, action, min_confidence, enabled,"
    f" {O.stamp('updated_at')} as updated_at from ("
    " select e.id, e.name, coalesce(c.new_type, e.entity_type) as entity_type,"
    " case when c.new_type is not null then 'SECRET' end as category,"
    " upper(coalesce(c.new_action, e.action)) as action,"
    " case when c.op = 'patch' then 0.25::double else e.min_confidence end as min_confidence, e.enabled,"
    f" case when c.op = 'patch' then {AS_OF_SQL} else e.created_at end as updated_at"
    " from er e left join ch c on c.id = e.id and c.op <> 'create' where c.op is distinct from 'delete'"
    " union all select id, name, entity_type, category, action, min_confidence, enabled, updated_at from cr)",
)
def upsert_rules(spark, sf):
    """Patches, deletes and new rules, derived from the events as well; most ids
    have a second change, of which only that counts what it names.
    """
    table = event_rules(spark, sf)
    e = F.col("event_id")
    events = D.table(spark, sf, "events").select("event_id").filter(e % 7 < 3)
    patch, create = e % 7 == 0, e % 7 == 2
    text = lambda c: F.lit(None).cast("string").alias(c)
    changes = events.select(
        F.md5(F.concat(F.when(create, "new|").otherwise("r|"), e.cast("string"))).alias("id"),
        F.when(patch, "patch").when(create, "create").otherwise("delete").alias("op"),
        F.when(create, F.concat(F.lit("new "), e.cast("string"))).alias("name"),
        text("description"),
        F.when(create, "EMAIL").when(patch & (e % 2 == 0), "JWT").alias("entity_type"),
        F.when(create, "mask").when(patch, "block").alias("action"),
        F.lit(None).cast("double").alias("min_confidence"),
        F.lit(None).cast("boolean").alias("enabled"),
    )
    again = F.when(create, "new|").otherwise("r|")
    back = ~patch & ~create & (e % 3 == 1)
    second = events.filter(patch | create | back).select(
        F.lit(2).alias("seq"),
        F.md5(F.concat(again, e.cast("string"))).alias("id"),
        F.when(back, "create").otherwise("patch").alias("op"),
        F.when(back, F.concat(F.lit("again "), e.cast("string"))).alias("name"),
        text("description"),
        F.when(back, "EMAIL").alias("entity_type"),
        F.when(back, "mask").alias("action"),
        F.when(patch, F.lit(0.25)).alias("min_confidence"),
        F.when(create & (e % 2 == 0), F.lit(False)).alias("enabled"),
    )
    changes = changes.withColumn("seq", F.lit(1)).unionByName(second)
    new = rules.upsert_rules(table, changes, F.lit(str(D.AS_OF)).cast("timestamp"))
    return new.select(
        "id",
        "name",
        "entity_type",
        "category",
        "action",
        "min_confidence",
        "enabled",
        stamp_col("updated_at").alias("updated_at"),
    )


@query(
    "seed_rules",
    O.with_(EVENT_RULES, O.RULES)
    + "select 'rows' as was, entity_type, action, count(*) as n from er group by all"
    " union all select 'empty', entity_type, action, 1 from rule",
)
def seed_rules(spark, sf):
    """A table that has rows is left as it is, an empty one gets the defaults."""
    table, seed = event_rules(spark, sf), rules.default_rules(spark)
    empty = table.filter("id is null")
    both = [
        rules.seed_rules(t, seed).select(F.lit(was).alias("was"), "entity_type", "action")
        for was, t in (("rows", table), ("empty", empty))
    ]
    return both[0].unionByName(both[1]).groupBy("was", "entity_type", "action").agg(F.count("*").alias("n"))


_FILE_RULES = (
    "rule as (select case event_type when 'error' then 'EMAIL' when 'click' then 'PHONE' else 'JWT' end as entity_type,"
    " 'BLOCK' as action, (count(*) % 100) / 100.0::double as min_confidence from events group by 1)"
)


@query(
    "read_rules",
    O.with_(O.DOCS, O.ENTITY_DIM, _FILE_RULES, O.raw("docs"), O.merged("raw"), O.actionable("merged"), O.decided("docs", "acts"))
    + "select 'events-1' as policy_id, decision, count(*) as n from decided group by decision",
)
def read_rules(spark, sf):
    """A policy file with a rule per kind of event, used to decide on the documents."""
    kind = (
        F.when(F.col("event_type") == "error", "EMAIL").when(F.col("event_type") == "click", "PHONE").otherwise("JWT")
    )
    events = D.table(spark, sf, "events").groupBy(kind.alias("kind")).agg((F.count("*") % 100 / 100).alias("c"))
    line = F.format_string("- {entity_type: %s, action: BLOCK, min_confidence: %s}", "kind", F.col("c").cast("string"))
    listed = events.agg(F.array_sort(F.collect_list(line)).alias("l"))  # three rules
    path = shared_dir(spark, "policy")
    body = F.concat(F.lit("policy_id: events-1\nrules:\n"), F.array_join("l", "\n"))
    listed.select(body).coalesce(1).write.text(path)
    _, policy = rules.read_rules(spark, path)
    found = S.scan(D.planted(spark, sf), policy)
    return found.groupBy("decision").agg(F.count("*").alias("n")).select(
        F.lit(policy.policy_id).alias("policy_id"), "decision", "n"
    )


# --- requests -----------------------------------------------------------------

_MSG = [O.MESSAGES, O.ENTITY_DIM, O.RULES, O.raw("messages"), O.merged("raw"), O.actionable("merged")]
_REQ = [
    *_MSG,
    "fm as (select m.*, g.conv_id, g.turn from merged m join messages g on g.k = m.k)",
    f"dec as (select g.conv_id, {O.action_of('max(' + O.RANK + ')')} as decision from messages g"
    " left join acts a on a.k = g.k group by g.conv_id)",
    O.redacted("messages", "merged"),
    "msg as (select g.conv_id, g.turn, g.role, case when d.decision <> 'ALLOW' then r.text else g.text end as content"
    " from messages g join dec d on d.conv_id = g.conv_id join red r on r.k = g.k)",
    "prompt as (select conv_id, string_agg('[' || role || ']: ' || content, chr(10) order by turn) as prompt"
    " from msg group by conv_id)",
    "per as (select conv_id, turn, entity_type, count(*) as n from fm group by all)",
    "lastper as (select conv_id, entity_type, arg_max(n, turn) as n, sum(n) as total from per group by all)",
    "cnt as (select l.conv_id, string_agg(entity_type || '=' || n, ',' order by entity_type) as counts"
    " from lastper l join dec d on d.conv_id = l.conv_id where d.decision <> 'ALLOW' group by l.conv_id)",
    "rea as (select g.conv_id, string_agg(a.action || ': ' || a.entity_type || ' detected (confidence=' ||"
    " printf('%.2f', a.confidence) || ', detector=' || a.detector || ')', ' | ' order by g.turn, a.s) as reasons"
    " from acts a join messages g on g.k = a.k group by g.conv_id)",
]


@query(
    "scannable_messages",
    "select cast(conv_id as varchar) as request_id, idx, role, text as content from (select conv_id, role, text,"
    " row_number() over (partition by conv_id order by turn) - 1 as idx from conversations) where length(text) > 0",
)
def scannable_messages(spark, sf):
    """Requests as bodies with an array of messages, back to scannable rows."""
    turns = D.table(spark, sf, "conversations")
    bodies = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias(
            "messages"
        )
    )
    found = R.scannable_messages(bodies, "conv_id")
    return found.select(F.col("conv_id").cast("string").alias("request_id"), *big("idx"), "role", "content")


@query(
    "user_of",
    "select cast(event_id as varchar) as request_id, coalesce("
    " nullif(case when event_id % 3 = 0 then '' when event_id % 3 = 1 then 'u' || user_id end, ''),"
    " nullif(case when event_id % 2 = 0 then 'h' || user_id else '' end, ''), 'anonymous') as user_id from events",
)
def user_of(spark, sf):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    users = D.table(spark, sf, "events").select(
        e.cast("string").alias("request_id"),
        F.when(e % 3 == 0, "").when(e % 3 == 1, F.concat(F.lit("u"), u)).alias("user"),
        F.when(e % 2 == 0, F.concat(F.lit("h"), u)).otherwise("").alias("x_user_id"),
    )
    return users.select("request_id", R.user_of().alias("user_id"))


def scanned_messages(spark, sf):
    return R.scan_messages(D.messages(spark, sf))


@query(
    "evaluate_request",
    O.with_(*_REQ)
    + "select cast(d.conv_id as varchar) as request_id, d.decision as input_decision,"
    " (select count(*) from fm where fm.conv_id = d.conv_id) as n_findings,"
    " (select count(*) from acts a join messages g on g.k = a.k where g.conv_id = d.conv_id) as n_actionable"
    " from dec d",
)
def evaluate_request(spark, sf):
    return R.request_decisions(scanned_messages(spark, sf), "request_id")


@query(
    "redact_messages",
    O.with_(*_REQ)
    + "select cast(conv_id as varchar) as request_id, turn as idx, role, content from msg",
)
def redact_messages(spark, sf):
    out = R.redact_messages(scanned_messages(spark, sf), "request_id")
    return out.select("request_id", *big("idx"), "role", "content")


@query(
    "assemble_prompt",
    O.with_(*_REQ) + "select cast(conv_id as varchar) as request_id, prompt from prompt",
)
def assemble_prompt(spark, sf):
    """Prompts of the messages as forwarded."""
    sent = R.redact_messages(scanned_messages(spark, sf), "request_id")
    return R.assemble_prompt(sent, "request_id")


@query(
    "request_redaction_counts",
    O.with_(*_REQ)
    + "select cast(conv_id as varchar) as request_id,"
    " string_agg(entity_type || '=' || n, ',' order by entity_type) as last_wins,"
    " string_agg(entity_type || '=' || cast(total as bigint), ',' order by entity_type) as summed"
    " from lastper group by conv_id",
)
def request_redaction_counts(spark, sf):
    """Counts of a request's messages: the last message per type, and the sum."""
    found = scanned_messages(spark, sf).select("request_id", "idx", "counts")
    found = found.filter(F.size("counts") > 0)
    return R.request_counts(found, ["request_id"]).select(
        "request_id",
        counts_text("input_redactions").alias("last_wins"),
        counts_text("summed").alias("summed"),
    )


_OUT = [
    O.CHOICES,
    O.raw("choices", "oraw"),
    O.merged("oraw", "omerged"),
    O.actionable("omerged", "oacts", is_output=True),
    O.decided("choices", "oacts", "odecided"),
    O.redacted("choices", "oacts", "ored"),
    "och as (select c.conv_id, c.turn, c.k, d.decision, case when d.decision = 'ALLOW' then c.text else r.text end as text"
    " from choices c join odecided d on d.k = c.k join ored r on r.k = c.k)",
    "ocnt as (select o.conv_id, a.entity_type, count(*) as n from oacts a join och o on o.k = a.k"
    " where o.decision <> 'ALLOW' group by all)",
    "outs as (select conv_id, coalesce(arg_max(decision, turn) filter (decision <> 'ALLOW'), 'ALLOW') as output_decision,"
    " string_agg(text, chr(10) order by turn) as response_redacted from och group by conv_id)",
    "ocounts as (select conv_id, string_agg(entity_type || '=' || n, ',' order by entity_type) as counts"
    " from ocnt group by conv_id)",
]


@query(
    "scan_outputs",
    O.with_(O.ENTITY_DIM, O.RULES, *_OUT)
    + "select cast(o.conv_id as varchar) as request_id, o.output_decision,"
    " coalesce(c.counts, '') as output_redactions, o.response_redacted"
    " from outs o left join ocounts c on c.conv_id = o.conv_id",
)
def scan_outputs(spark, sf):
    out = R.scan_outputs(D.choices(spark, sf), "request_id")
    return out.select(
        "request_id",
        "output_decision",
        counts_text("output_redactions").alias("output_redactions"),
        "response_redacted",
    )


_BUILT = [
    *_REQ,
    *_OUT,
    f"meta as (select event_id as conv_id, {O.EVENT_COLUMNS} from events where event_id % {D.NO_META} <> 5)",
    "built as (select cast(d.conv_id as varchar) as request_id, m.created_at, m.user_id, m.model,"
    " d.decision as input_decision,"
    " case when d.decision <> 'BLOCK' then coalesce(o.output_decision, 'ALLOW') end as output_decision,"
    " coalesce(rea.reasons, '') as reasons, coalesce(cnt.counts, '') as input_redactions,"
    " case when d.decision <> 'BLOCK' then coalesce(oc.counts, '') else '' end as output_redactions,"
    " sha256(p.prompt) as prompt_hash, p.prompt as prompt_redacted,"
    " case when d.decision <> 'BLOCK' then o.response_redacted end as response_redacted,"
    " m.detection_latency_ms, case when d.decision <> 'BLOCK' then m.any_llm_latency_ms end as llm_latency_ms,"
    " m.total_latency_ms from dec d left join meta m on m.conv_id = d.conv_id join prompt p on p.conv_id = d.conv_id"
    " left join rea on rea.conv_id = d.conv_id left join cnt on cnt.conv_id = d.conv_id"
    " left join outs o on o.conv_id = d.conv_id left join ocounts oc on oc.conv_id = d.conv_id)",
]
_BUILT_COLUMNS = (
    "request_id, user_id, model, input_decision, output_decision, reasons, input_redactions,"
    " output_redactions, prompt_hash, prompt_redacted, response_redacted,"
    " cast(detection_latency_ms as bigint) as detection_latency_ms,"
    " cast(llm_latency_ms as bigint) as llm_latency_ms, cast(total_latency_ms as bigint) as total_latency_ms"
)


def _flat_audit(rows):
    return rows.select(
        "request_id",
        stamp_col("created_at").alias("created_at"),
        "user_id",
        "model",
        "input_decision",
        "output_decision",
        F.array_join("reasons", " | ").alias("reasons"),
        counts_text("input_redactions").alias("input_redactions"),
        counts_text("output_redactions").alias("output_redactions"),
        "prompt_hash",
        "prompt_redacted",
        "response_redacted",
        *big("detection_latency_ms", "llm_latency_ms", "total_latency_ms"),
    )


@query(
    "build_audit",
    O.with_(*_BUILT)
    + f"select {_BUILT_COLUMNS}, {O.stamp('created_at')} as created_at from built",
)
def build_audit(spark, sf):
    return _flat_audit(D.conversation_audit(spark, sf))


@query(
    "write_audit",
    O.with_(*_BUILT)
    + f"select {_BUILT_COLUMNS}, {O.stamp('created_at')} as created_at from built",
)
def write_audit(spark, sf):
    """The same rows after a round trip through the day-partitioned table."""
    path = shared_dir(spark, "audit")
    tables.write_audit(D.conversation_audit(spark, sf), path)
    return _flat_audit(tables.read_audit(spark, path))


@query(
    "read_audit",
    O.with_(*_BUILT)
    + "select cast(created_at as date)::varchar as day, input_decision, count(*) as n,"
    " cast(sum(total_latency_ms) as bigint) as total_ms from built group by all",
)
def read_audit(spark, sf):
    """Pruned read: three columns of every day's partition."""
    path = shared_dir(spark, "audit")
    tables.write_audit(D.conversation_audit(spark, sf), path)
    rows = tables.read_audit(spark, path, "dt", "input_decision", "total_latency_ms")
    return rows.groupBy(F.col("dt").cast("string").alias("day"), "input_decision").agg(
        F.count("*").alias("n"), F.sum("total_latency_ms").alias("total_ms")
    )


_META_FIELDS = ("input_decision", "output_decision", "policy_id")


@query(
    "decision_metadata",
    O.with_(*O.AUDIT)
    + "select request_id, input_decision, output_decision, policy_id, 'regex' as detector,"
    " cast(llm_latency_ms as varchar) as llm, cast(total_latency_ms as varchar) as total from audit",
)
def decision_metadata(spark, sf):
    """Fields of the metadata block, read back from its JSON text."""
    field = lambda path: F.get_json_object("ppg_json", f"$.{path}")
    return R.decision_metadata(D.audit(spark, sf)).select(
        "request_id",
        *[field(f).alias(f) for f in _META_FIELDS],
        field("detectors_used[0]").alias("detector"),
        field("latency_ms.llm").alias("llm"),
        field("latency_ms.total").alias("total"),
    )


@query(
    "export_csv",
    O.with_(*O.AUDIT)
    + f"select request_id, {O.stamp('created_at')} as created_at, user_id, input_decision,"
    " '{\"' || replace(replace(input_redactions, '=', '\":'), ',', ',\"') || '}' as input_redactions"
    " from audit where input_decision = 'BLOCK'",
)
def export_csv(spark, sf):
    """The blocked part of the log as CSV, read back."""
    path = shared_dir(spark, "export")
    log = A.filter_log(D.audit(spark, sf), ["BLOCK"]).select(
        "request_id", "created_at", "user_id", "input_decision", "input_redactions"
    )
    tables.export_csv(log, path)
    schema = (
        "request_id string, created_at timestamp, user_id string, input_decision string,"
        " input_redactions string"
    )
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("created_at", stamp_col("created_at"))


# --- audit filters and projections ---------------------------------------------


def _ids(rows):
    return rows.select("request_id", stamp_col("created_at").alias("created_at"))


_IDS = f"select request_id, {O.stamp('created_at')} as created_at from audit where "
_AUDIT = O.with_(*O.AUDIT)


@query(
    "filter_time",
    _AUDIT + _IDS + "created_at >= timestamp '2024-01-10' and created_at <= timestamp '2024-01-12 12:00:00'",
)
def filter_time(spark, sf):
    return _ids(A.filter_time(D.audit(spark, sf), "2024-01-10", "2024-01-12 12:00:00"))


@query("filter_decision", _AUDIT + _IDS + "input_decision = 'MASK'")
def filter_decision(spark, sf):
    return _ids(A.filter_decision(D.audit(spark, sf), "mask"))


@query(
    "filter_entity",
    _AUDIT + _IDS + "input_redactions like '%AWS\\_KEY=%' escape '\\' or output_redactions like '%AWS\\_KEY=%' escape '\\'",
)
def filter_entity(spark, sf):
    return _ids(A.filter_entity(D.audit(spark, sf), "AWS_KEY"))


@query(
    "search_text",
    _AUDIT + _IDS + "prompt_redacted like '%REDACTED_SSN%' or response_redacted like '%REDACTED_SSN%'",
)
def search_text(spark, sf):
    return _ids(A.search_text(D.audit(spark, sf), "REDACTED_SSN"))


@query(
    "filter_log",
    _AUDIT + _IDS + "input_decision in ('MASK', 'BLOCK') and user_id ilike '%1%' and model ilike '%VIEW%'"
    " and cast(created_at as date) between date '2024-01-05' and date '2024-01-20'",
)
def filter_log(spark, sf):
    log = A.filter_log(
        D.audit(spark, sf), ["MASK", "BLOCK"], "1", "VIEW", "2024-01-05", "2024-01-20"
    )
    return _ids(log)


@query("nonempty_redactions", _AUDIT + _IDS + "input_redactions <> ''")
def nonempty_redactions(spark, sf):
    return _ids(A.nonempty_redactions(D.audit(spark, sf)))


@query(
    "effective_decision",
    _AUDIT
    + "select input_decision, output_decision, effective as decision, count(*) as n from audit group by all",
)
def effective(spark, sf):
    return (
        D.audit(spark, sf)
        .groupBy("input_decision", "output_decision", effective_decision().alias("decision"))
        .agg(F.count("*").alias("n"))
    )


_TYPES = (
    "types as (select k, string_agg(distinct entity_type, ',' order by entity_type) as entity_types from"
    " (select * from in_counts union all select * from out_counts) group by k)"
)


@query(
    "audit_record",
    O.with_(*O.AUDIT, _TYPES)
    + f"select a.id, {O.stamp('created_at')} as ts, effective as decision, coalesce(t.entity_types, '') as entity_types,"
    " total_latency_ms::double as latency_ms, substr(prompt_redacted, 1, 200) as request_preview,"
    " user_id as tenant_id from audit a left join types t on t.k = a.k",
)
def audit_record(spark, sf):
    return A.audit_record(D.audit(spark, sf)).select(
        "id",
        stamp_col("ts").alias("ts"),
        "decision",
        F.array_join("entity_types", ",").alias("entity_types"),
        "latency_ms",
        "request_preview",
        "tenant_id",
    )


@query(
    "audit_detail",
    _AUDIT
    + "select id, lower(input_decision) as input_decision, lower(output_decision) as output_decision,"
    " effective as decision, model, reasons, input_redactions, output_redactions, response_redacted,"
    " policy_id, prompt_redacted from audit where request_id = '17'",
)
def audit_detail(spark, sf):
    """A lookup on the stored table, which skips row groups by their Bloom filters."""
    path = shared_dir(spark, "audit")
    tables.write_audit(D.audit_events(spark, sf), path, texts=D.audit_texts(spark, sf))
    row = A.audit_detail(tables.read_audit(spark, path), "17", "request_id")
    return row.select(
        "id",
        "input_decision",
        "output_decision",
        "decision",
        "model",
        F.array_join("reasons", " | ").alias("reasons"),
        counts_text("input_redactions").alias("input_redactions"),
        counts_text("output_redactions").alias("output_redactions"),
        "response_redacted",
        "policy_id",
        "prompt_redacted",
    )


@query(
    "latency_breakdown",
    O.with_(
        *O.AUDIT,
        "parts as (select request_id, detection_latency_ms as d, coalesce(llm_latency_ms, 0) as l, total_latency_ms as t from audit)",
    )
    + "select request_id, 'detection' as stage, cast(d as bigint) as ms from parts"
    " union all select request_id, 'llm', cast(l as bigint) from parts"
    " union all select request_id, 'other', cast(greatest(0, t - d - l) as bigint) from parts",
)
def latency_breakdown(spark, sf):
    return A.latency_breakdown(D.audit(spark, sf)).select("request_id", "stage", *big("ms"))


# --- aggregates ----------------------------------------------------------------


@query(
    "order_recent",
    _AUDIT
    + f"select request_id, {O.stamp('created_at')} as created_at, user_id, reasons from audit"
    " where input_decision = 'BLOCK' order by audit.created_at desc, id desc limit 5",
)
def order_recent(spark, sf):
    blocks = A.order_recent(A.filter_decision(D.audit(spark, sf), "BLOCK"), 5)
    return blocks.select(
        "request_id",
        stamp_col("created_at").alias("created_at"),
        "user_id",
        F.array_join("reasons", " | ").alias("reasons"),
    )


@query(
    "keyset_page",
    _AUDIT
    + f"select id, {O.stamp('created_at')} as created_at, input_decision from audit"
    " order by audit.created_at desc, id desc limit 51 offset 100",
)
def keyset(spark, sf):
    """Third page of fifty of an audit table stored by day, reached by two cursors."""
    path, cursor = shared_dir(spark, "pages"), None
    rows = D.audit(spark, sf).select("id", "created_at", "input_decision")
    tables.write_audit(rows, path, "pages")
    rows = spark.read.schema(
        "id string, created_at timestamp, input_decision string, job string, dt date"
    ).parquet(path)
    for _ in range(2):
        cursor = page_cursor(day_page(rows, 50, cursor), 50)
    page = day_page(rows, 50, cursor)
    return page.select("id", stamp_col("created_at").alias("created_at"), "input_decision")


_EFFECTIVE = ", ".join(
    f"count(*) filter (effective = '{d}') as {d}" for d in ("allow", "mask", "block")
)


def _ranks(src: str = "total_latency_ms") -> str:
    return ", ".join(
        f"cast(coalesce({O.nearest(src, p)}, 0) as double) as {name}"
        for name, p in A.PERCENTILES.items()
    )


_UNTIMED = (
    "untimed as (select * replace (case when cast(request_id as bigint) % 9 <> 4 then total_latency_ms end"
    " as total_latency_ms) from audit)"
)


def untimed(spark, sf):
    """The audit table, some rows of which have no latency."""
    timed = F.col("request_id").cast("bigint") % 9 != 4
    return D.audit(spark, sf).withColumn("total_latency_ms", F.when(timed, F.col("total_latency_ms")))


@query(
    "stats_summary",
    O.with_(*O.AUDIT, _UNTIMED)
    + f"select '7d' as \"window\", count(*) as total, {_EFFECTIVE}, {_ranks()} from untimed"
    f" where {since('7 days')}",
)
def stats_summary(spark, sf):
    return A.stats_summary(untimed(spark, sf), "7d", D.AS_OF)


@query("latency_percentiles", _AUDIT + f"select input_decision, {_ranks()} from audit group by all")
def latency_percentiles(spark, sf):
    return A.latency_percentiles(D.audit(spark, sf), ["input_decision"])


@query(
    "top_entities",
    O.with_(
        *O.AUDIT,
        "e as (select c.entity_type, c.n from audit a join"
        " (select * from in_counts union all select * from out_counts) c on c.k = a.k"
        f" where a.{since('7 days')})",
    )
    + "select entity_type, cast(sum(n) as bigint) as n from e group by entity_type order by n desc, entity_type limit 10",
)
def top_entities(spark, sf):
    return A.top_entities(D.audit(spark, sf), "7d", D.AS_OF)


@query(
    "timeseries",
    O.with_(
        *O.AUDIT,
        _UNTIMED,
        f"b as (select least(28, cast(floor(epoch_us(created_at - ({AS_OF_SQL} - interval 7 days)) / 21600000000) as int)) as i,"
        f" effective, total_latency_ms from untimed where {since('7 days')})",
        f"g as (select i, {_EFFECTIVE}, {O.nearest('total_latency_ms', 0.95)} as p95 from b group by i)",
    )
    + f"select strftime({AS_OF_SQL} - interval 7 days + to_hours(6 * s.i), {O.STAMP}) as bucket,"
    " coalesce(allow, 0) as allow, coalesce(mask, 0) as mask, coalesce(block, 0) as block,"
    " coalesce(p95, 0)::double as p95_ms from (select unnest(range(0, 29)) as i) s left join g on g.i = s.i",
)
def timeseries(spark, sf):
    points = A.timeseries(untimed(spark, sf), "7d", "6h", D.AS_OF)
    return points.withColumn("bucket", stamp_col("bucket"))


@query("count_by_input_decision", _AUDIT + "select input_decision, count(*) as n from audit group by all")
def count_by_input_decision(spark, sf):
    return A.count_by_input_decision(D.audit(spark, sf))


@query("total_requests", _AUDIT + "select count(*) as n from audit")
def total_requests(spark, sf):
    return A.total_requests(D.audit(spark, sf))


@query(
    "daily_counts",
    _AUDIT + f"select cast(created_at as date)::varchar as day, count(*) as n from audit where {since('7 days')} group by all",
)
def daily_counts(spark, sf):
    days = A.daily_counts(D.audit(spark, sf), D.AS_OF)
    return days.withColumn("day", F.col("day").cast("string"))


@query(
    "avg_latencies",
    _AUDIT
    + "select round(avg(detection_latency_ms), 1) as avg_detection_ms, round(avg(llm_latency_ms), 1) as avg_llm_ms,"
    " round(avg(total_latency_ms), 1) as avg_total_ms from audit where total_latency_ms is not null",
)
def avg_latencies(spark, sf):
    return A.avg_latencies(D.audit(spark, sf))


@query(
    "input_redaction_totals",
    O.with_(*O.AUDIT)
    + "select c.entity_type, cast(sum(c.n) as bigint) as n from audit a join in_counts c on c.k = a.k group by all",
)
def input_redaction_totals(spark, sf):
    return A.input_redaction_totals(D.audit(spark, sf))


@query(
    "log_summary",
    _AUDIT
    + "select count(*) as records, round(avg(total_latency_ms), 4) as avg_latency_ms,"
    " round(count(*) filter (input_decision = 'BLOCK') * 100.0::double / count(*), 4) as block_pct from audit"
    " where model ilike '%click%'",
)
def log_summary(spark, sf):
    summary = A.log_summary(A.filter_log(D.audit(spark, sf), model="click"))
    return summary.select(
        "records",
        F.round("avg_latency_ms", 4).alias("avg_latency_ms"),
        F.round("block_pct", 4).alias("block_pct"),
    )


@query(
    "block_rate",
    _AUDIT
    + "select round(count(*) filter (effective = 'block') * 100.0::double / nullif(count(*), 0), 1) as block_rate"
    f" from audit where {since('24 hours')}",
)
def block_rate(spark, sf):
    return A.block_rate(D.audit(spark, sf), "24h", D.AS_OF)


# --- metrics --------------------------------------------------------------------


@query(
    "requests_total",
    _AUDIT + "select input_decision as decision, count(*) as n from audit group by all",
)
def requests_total(spark, sf):
    return M.requests_total(D.audit(spark, sf))


_EV_FINDINGS = O.with_(
    *O.AUDIT,
    "evf as (select ev.request_id, ev.created_at, d.decision as input_decision, m.entity_type, m.confidence,"
    " m.detector from ev join merged m on m.k = ev.k join decided d on d.k = ev.k)",
    "eva as (select ev.request_id, d.decision as input_decision, a.entity_type"
    " from ev join acts a on a.k = ev.k join decided d on d.k = ev.k)",
)


@query(
    "detections_total",
    _EV_FINDINGS + "select entity_type, detector, count(*) as n from evf group by all",
)
def detections_total(spark, sf):
    return M.detections_total(D.audit_findings(spark, sf))


@query(
    "blocks_total",
    _EV_FINDINGS + "select entity_type, count(*) as n from eva where input_decision = 'BLOCK' group by all",
)
def blocks_total(spark, sf):
    return M.blocks_total(D.audit_findings(spark, sf, "actionable"))


def _buckets(bounds) -> str:
    """The upper bounds of a histogram, one row each."""
    parts = [
        f"select '{float(b)!r}' as le, {float(b)!r}::double as ub union all " for b in bounds
    ]
    return f"le as ({''.join(parts)} select '+Inf', 'infinity'::double)"


@query(
    "confidence_histogram",
    _EV_FINDINGS.rstrip()
    + ", "
    + _buckets(CONFIDENCE_BOUNDS)
    + " select f.detector, le.le, count(*) filter (f.confidence <= le.ub) as cumulative from evf f, le group by all",
)
def confidence_histogram(spark, sf):
    return M.confidence_histogram(D.audit_findings(spark, sf))


def _register_latency_histograms():
    columns = {"detection": "detection", "llm": "llm", "request": "total"}
    for stage, column in columns.items():
        seconds = f"{column}_latency_ms / 1000.0::double"

        @query(
            f"latency_histogram_{stage}",
            O.with_(*O.AUDIT, _buckets(LATENCY_BOUNDS[stage]))
            + f"select le.le, count(*) filter ({seconds} <= le.ub) as cumulative from audit, le group by all",
        )
        def run(spark, sf, stage=stage):
            return M.latency_histogram(D.audit(spark, sf), stage)


_register_latency_histograms()


@query(
    "rate_by_window",
    _AUDIT
    + f"select strftime(time_bucket(interval 1 hour, created_at), {O.STAMP}) as window_start, input_decision,"
    " round(count(*) / 3600.0::double, 8) as rate from audit group by all",
)
def rate_by_window(spark, sf):
    rates = M.rate_by_window(D.audit(spark, sf), "1h")
    return rates.select(
        stamp_col("window_start").alias("window_start"),
        "input_decision",
        F.round("rate", 8).alias("rate"),
    )


def _quantile(name: str, q: float) -> str:
    rank = f"{q}::double * total"
    return (
        f"round(max(case when total > 0 and cumulative >= {rank} and below < {rank} then"
        f" case when le = '+Inf' then 10.0 else lo + (ub - lo) * (({rank} - below) / (cumulative - below)) end end), 9)"
        f" as {name}"
    )


@query(
    "histogram_quantile",
    O.with_(
        *O.AUDIT,
        _buckets(LATENCY_BOUNDS["request"]),
        "h as (select time_bucket(interval 6 hours, created_at) as w, le.le, le.ub,"
        " count(*) filter (total_latency_ms / 1000.0::double <= le.ub) as cumulative from audit, le group by all)",
        "s as (select *, coalesce(lag(cumulative) over (partition by w order by ub), 0) as below,"
        " coalesce(lag(ub) over (partition by w order by ub), 0) as lo, max(cumulative) over (partition by w) as total from h)",
    )
    + f"select strftime(w, {O.STAMP}) as window_start, {_quantile('p50', 0.5)}, {_quantile('p95', 0.95)},"
    f" {_quantile('p99', 0.99)} from s group by w",
)
def histogram_quantile(spark, sf):
    quantiles = M.latency_quantiles(D.audit(spark, sf), "6h")
    return quantiles.select(
        stamp_col("window_start").alias("window_start"),
        *[F.round(p, 9).alias(p) for p in ("p50", "p95", "p99")],
    )


_TOPK_FROM = D.AS_OF - timedelta(days=7)


@query(
    "topk_increase",
    _EV_FINDINGS
    + f"select entity_type, count(*) as n from evf where created_at >= timestamp '{_TOPK_FROM}'"
    f" and created_at < {AS_OF_SQL} group by entity_type order by n desc, entity_type limit 10",
)
def topk_increase(spark, sf):
    return M.topk_increase(D.audit_findings(spark, sf), _TOPK_FROM, D.AS_OF)


@query(
    "confidence_heatmap",
    _EV_FINDINGS.rstrip()
    + ", "
    + _buckets(CONFIDENCE_BOUNDS)
    + f" select strftime(time_bucket(interval 1 day, f.created_at), {O.STAMP}) as window_start, le.le,"
    " count(*) filter (f.confidence <= le.ub) as cumulative from evf f, le group by all",
)
def confidence_heatmap(spark, sf):
    heat = M.confidence_heatmap(D.audit_findings(spark, sf), "1d")
    return heat.withColumn("window_start", stamp_col("window_start"))


@query(
    "bench_summary",
    "with r as (select cast(user_id % 4 as bigint) as concurrency, value as latency_ms,"
    " case when event_type = 'error' then null else 200 end as status,"
    " case event_type when 'click' then 'ALLOW' when 'view' then 'MASK' when 'signup' then 'BLOCK' end as decision"
    " from events), ok as (select *, cast(round(latency_ms * 100) as bigint) as cents from r where status is not null),"
    f" p as (select concurrency, {', '.join(O.nearest('cents', p) + ' / 100.0::double as ' + n for n, p in A.PERCENTILES.items())}"
    " from ok group by concurrency)"
    " select r.concurrency, count(status) as total_requests, count(*) - count(status) as errors,"
    " round(count(status) / 20.0::double, 1) as requests_per_sec,"
    " round(max(latency_ms) filter (status is not null), 2) as max_ms,"
    " count(*) filter (status is not null and decision = 'ALLOW') as allow,"
    " count(*) filter (status is not null and decision = 'MASK') as mask,"
    " count(*) filter (status is not null and decision = 'BLOCK') as block,"
    " any_value(p.p50_ms) as p50_ms, any_value(p.p95_ms) as p95_ms, any_value(p.p99_ms) as p99_ms"
    " from r left join p on p.concurrency = r.concurrency group by r.concurrency",
)
def bench_summary(spark, sf):
    kind = F.col("event_type")
    results = D.table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("concurrency"),
        F.col("value").alias("latency_ms"),
        F.when(kind != "error", 200).alias("status"),
        F.when(kind == "click", "ALLOW")
        .when(kind == "view", "MASK")
        .when(kind == "signup", "BLOCK")
        .alias("decision"),
    )
    return M.bench_summary(results, 20.0)
