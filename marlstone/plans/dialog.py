"""Safety, routing, provider state, answers, traces and speech over the stand-in tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer, asr, dispatch, evaluate, grounding, lexical, routing, safety, state, turn
from .common import query, table
from .retrieval import LEXICAL, RANKED, asked, docs, stored

HOSTS = ["example.com", "tionsh.example.net", "thther.example.org"]
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '')"
_IN = "list_contains([" + ", ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in HOSTS) + "], true)"


@query(f"select page_id, {_HOST} as host from pages")
def host_extract(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.host_of(F.col("url")).alias("host"))


@query(f"select page_id, {_IN} as allowed, case when not {_IN} then 'host not allowed: ' || host end as blocked_reason from (select page_id, {_HOST} as host from pages)")
def allowlist_partition(spark, d) -> DataFrame:
    return safety.with_block_reason(table(spark, d, "pages").select("page_id", "url"), HOSTS).select("page_id", "allowed", "blocked_reason")


RULES = {"both": [["shea", "onen"], ["thst", "rean"]], "rare": [["zzz"], ["the"]], "three": [["an"], ["ou"], ["ver"]]}
_START = r"(^|[^\p{L}\p{N}_])"


@query("select doc_id, concat_ws(',', " + ", ".join(f"case when {' and '.join(f'''regexp_matches(lower(text || ' ' || source), '{_START}({'|'.join(g)})')''' for g in groups)} then '{n}' end" for n, groups in RULES.items()) + ") as flags from documents")
def hazard_flags(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(safety.hazard_flags([F.col("text"), F.col("source")], RULES), ",").alias("flags"))


PATTERNS = {"near": "(the|of)[^a-z].{0,40}(ing|ed)[^a-z]", "der": "( der | die ).{0,10}( und | in )"}


@query("select conv_id, turn, concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '(?is){p}') then 'prompt_injection:{n}' end" for n, p in PATTERNS.items()) + ") as flags from conversations")
def injection_flags(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(safety.injection_flags(F.col("text"), PATTERNS), ",").alias("flags"))


# -- routing ----------------------------------------------------------------------------

OUT, IN, ECO, LIVE = ["shea", "ungver"], ["the", " la ", " de ", "und"], ["eau", "onth"], ["now", "tion"]
_ANY = lambda terms: "(" + " or ".join(f"contains(low, '{t}')" for t in terms) + ")"
ROUTED = f"""select conv_id, turn, low, case when {_ANY(OUT)} or not {_ANY(IN)} then 'out_of_catalog' else 'product_recommendation' end as task,
case when contains(low, 'ment') then 'ment' end as material, {_ANY(ECO)} as eco, {_ANY(LIVE)} as wants_live from (select *, lower(text) as low from conversations where role = 'user')"""


def routed(spark, d) -> DataFrame:
    users = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return routing.route(users, OUT, IN, ECO, LIVE, material="ment")


_STOP = "[" + ", ".join(f"'{w}'" for w in routing.STOP_WORDS) + "]"
_WORDS = f"list_filter(list_transform(string_split_regex(lower(trim(low)), '\\s+'), lambda w: trim(w, '.,!?$')), lambda w: (length(w) >= 3 or regexp_matches(w, '[0-9]')) and not list_contains({_STOP}, w))"


@query(f"select conv_id, turn, task, material, eco, wants_live, case when len({_WORDS}) > 0 then array_to_string({_WORDS}[1:7], ' ') else 'cleaner' end as keywords from ({ROUTED})")
def router_tasks(spark, d) -> DataFrame:
    return routed(spark, d).select("conv_id", "turn", "task", "material", "eco", "wants_live", F.array_join("keywords", " ").alias("keywords"))


@query(f"""select conv_id, turn, case when task = 'out_of_catalog' then 'web' when wants_live then 'private,web' else 'private' end as sources, task = 'out_of_catalog' or wants_live as call_web_search, 3::bigint as k,
case when task = 'out_of_catalog' then 'title' else 'sku,brand,title' end as reconcile_on, case when task <> 'out_of_catalog' then material end as material, case when task <> 'out_of_catalog' and turn % 3 = 1 then 20.0::double end as price_max,
case when len({_WORDS}) > 0 then array_to_string({_WORDS}[1:7], ' ') else 'cleaner' end as query, case when task = 'out_of_catalog' then 'title,source' else 'price,rating,price_per_oz,ingredients' end as criteria from ({ROUTED})""")
def planner_plan(spark, d) -> DataFrame:
    """Plans of routed turns, some of which state an upper price."""
    plans = routing.plan(routed(spark, d).withColumn("price_max", F.when(F.col("turn") % 3 == 1, F.lit(20.0))))
    return plans.select("conv_id", "turn", "sources", "call_web_search", "k", "reconcile_on", F.col("filters.material").alias("material"), F.col("filters.price_max").alias("price_max"), "query", "criteria")


CLASSES = {"code": ["the", "thon"], "academic": ["of", "inth", "to th"], "news": ["und", "der"], "company": ["la", "les"], "people": ["que", "que la"]}
QUESTION, DEEP = ["and", "le", "die"], ["heth", "onenti"]
_score = lambda terms: "(" + " + ".join(f"contains(low, '{t}')::int" if " " in t else f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])')::int" for t in terms) + ")"
_SCORES = ", ".join(f"{_score(v)} as s_{k}" for k, v in CLASSES.items())
_TOP = "greatest(" + ", ".join(f"s_{k}" for k in CLASSES) + ")"
_Q = "[" + ", ".join(f"'{w}'" for w in QUESTION) + "]"


@query(f"""select conv_id, turn, case when low = '' then 'general' when regexp_matches(low, '^who is\\b') then 'people' when {_ANY(DEEP)} then 'deep'
when len(words) <= 8 and list_contains({_Q}, words[1]) and s_code = 0 and s_company = 0 and s_people = 0 then 'quick'
when {_TOP} > 0 then case {' '.join(f"when s_{k} = {_TOP} then '{k}'" for k in CLASSES)} end when list_contains({_Q}, words[1]) then 'quick' else 'general' end as mode
from (select *, string_split_regex(low, '\\s+') as words, {_SCORES} from (select conv_id, turn, trim(lower(text)) as low from conversations))""")
def classify_query(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", routing.classify(F.col("text"), CLASSES, QUESTION, DEEP).alias("mode"))


MODES = {"click": ("brave", "tavily"), "view": ("tavily", "exa"), "error": ("gemini", "exa"), "signup": ("newsdata", "brave")}
_EXCLUDED = "list_filter(['brave', 'tavily', 'gemini'], lambda p: (event_id % 4 = 0 and p = 'brave') or (event_id % 3 = 0 and p = 'tavily') or (event_id % 5 = 0 and p = 'gemini'))"
_candidates = lambda pair: "[" + ", ".join(f"'{p}'" for p in dict.fromkeys([*pair, *routing.LAST_RESORT])) + "]"
_CHOICE = f"list_filter(case event_type {' '.join(f'''when '{k}' then {_candidates(v)}''' for k, v in MODES.items())} else {_candidates(())} end, lambda p: not list_contains(excluded, p))[1]"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _excluded():
    drop = [F.when(F.col("event_id") % n == 0, F.lit(p)) for n, p in ((4, "brave"), (3, "tavily"), (5, "gemini"))]
    return F.array_compact(F.array(*drop))


@query(f"select event_id, {_CHOICE} as provider from (select *, {_EXCLUDED} as excluded from events)")
def provider_select(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", routing.choose_provider(F.col("event_type"), _excluded(), MODES).alias("provider"))


@query(f"""select event_id, case when n < 3 then {_CHOICE} end as next_provider from (select *, list_distinct(list_concat({_EXCLUDED}, ['brave'])) as excluded, event_id % 6 as n from events)""")
def escalation_choice(spark, d) -> DataFrame:
    few = F.col("event_id") % 6 < routing.ESCALATE_BELOW
    return events(spark, d).select("event_id", F.when(few, routing.choose_provider(F.col("event_type"), F.array_union(_excluded(), F.array(F.lit("brave"))), MODES)).alias("next_provider"))


@query("select user_id, arg_min(event_type, event_id) as answer from events where event_type <> 'error' and value > 5 group by user_id")
def first_answer(spark, d) -> DataFrame:
    return events(spark, d).filter("event_type <> 'error' and value > 5").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("answer"))


@query("select event_type as provider, strftime(ts, '%Y-%m') as month, count(*) as calls from events group by all")
def usage_monthly(spark, d) -> DataFrame:
    return routing.usage(events(spark, d).withColumnRenamed("event_type", "provider"))


LIMITS = {"view": (2500, "monthly"), "click": (2000, "one-time"), "error": (None, "unlimited"), "purchase": (2200, "monthly"), "signup": (100000, "monthly")}
_LIMIT = "case provider " + " ".join(f"when '{k}' then {n or 0}" for k, (n, _) in LIMITS.items()) + " end::bigint"


@query(f"""select provider, calls, call_limit, round(ratio, 4) as ratio, case when call_limit > 0 then calls || '/' || call_limit else calls || '/unlimited' end as label, case when ratio >= 0.95::double then 'shift' when ratio >= 0.8::double then 'warn' else 'ok' end as state
from (select provider, calls, {_LIMIT} as call_limit, case when {_LIMIT} > 0 then calls / {_LIMIT}::double else 0.0::double end as ratio from (select event_type as provider, case when event_type = 'click' then count(*) else arg_max(n, m) end as calls
from (select event_type, m, count(*) over (partition by event_type, m) as n from (select event_type, strftime(ts, '%Y-%m') as m from events)) group by event_type))""")
def usage_summary(spark, d) -> DataFrame:
    return routing.usage_summary(events(spark, d).withColumnRenamed("event_type", "provider"), LIMITS)


@query("""select event_id as call_id, before, before >= 0.95::double * 1500 as gated from (select event_id, count(*) over (partition by event_type, strftime(ts, '%Y-%m') order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events)""")
def near_limit_gate(spark, d) -> DataFrame:
    calls = events(spark, d).select(F.col("event_id").alias("call_id"), F.col("event_type").alias("provider"), "ts")
    return routing.near_limit(calls, 1500).select("call_id", "before", "gated")


TTL = 86400


@query(f"""with recursive o as (select user_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id, event_type order by ts) as n from events),
f as (select user_id, event_type, n, t as opened, 0::bigint as hits from o where n = 1 union all select o.user_id, o.event_type, o.n, case when o.t < f.opened + {TTL}::bigint * 1000000 then f.opened else o.t end, f.hits + (o.t < f.opened + {TTL}::bigint * 1000000)::bigint
from f join o on o.user_id = f.user_id and o.event_type = f.event_type and o.n = f.n + 1)
select user_id, event_type, arg_max(hits, n) as hits, max(n) - arg_max(hits, n) as misses from f group by all""")
def ttl_cache_hits(spark, d) -> DataFrame:
    return state.cache_hits(events(spark, d), ["user_id", "event_type"], TTL)


@query("""select event_id as call_id, n * 60000000 + max(t - n * 60000000) over (partition by user_id order by t, event_id rows unbounded preceding) as start
from (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events)""")
def throttle_schedule(spark, d) -> DataFrame:
    calls = events(spark, d).select("user_id", F.col("event_id").alias("call_id"), F.unix_micros("ts").alias("at"))
    return state.throttle(calls, 60_000_000, ["user_id"]).select("call_id", "start")


@query("""select event_id as call_id, n * 60000000 + max(t - n * 60000000) over (order by t, event_id rows unbounded preceding) as start
from (select event_id, epoch_us(ts) as t, row_number() over (order by ts, event_id) as n from events)""")
def throttle_global(spark, d) -> DataFrame:
    """One caller for all calls."""
    calls = events(spark, d).select(F.col("event_id").alias("call_id"), F.unix_micros("ts").alias("at"))
    return state.throttle(calls, 60_000_000, []).select("call_id", "start")


# -- traces, speech, answers ---------------------------------------------------------------


def steps(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"), F.col("role").alias("node"), F.length("text").cast("long").alias("elapsed_ms"))


@query("select conv_id as trace_id, count(*) as n_steps, sum(length(text))::bigint as total_ms, string_agg(role, ' > ' order by turn) as path from conversations group by conv_id")
def trace_totals(spark, d) -> DataFrame:
    return answer.trace(steps(spark, d))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def session_history(spark, d) -> DataFrame:
    return state.last_of(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 3)


_N = "len(list_filter(string_split_regex(trim({0}), '\\s+'), lambda x: x <> ''))"


@query(f"select conv_id, turn, round({_N.format('text')} / 150.0::double * 60, 6) as seconds, {_N.format('text')} / 150.0::double * 60.0 <= 15 as fits from conversations")
def speech_budget(spark, d) -> DataFrame:
    seconds = T.speech_seconds(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(seconds, 6).alias("seconds"), (seconds <= T.SPEECH_SECONDS).alias("fits"))


@query(f"""with s as (select conv_id, turn, text, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from conversations),
e as (select conv_id, turn, unnest(ss) as one, generate_subscripts(ss, 1) as k from s), r as (select *, sum({_N.format('one')}) over (partition by conv_id, turn order by k) as n from e),
kept as (select conv_id, turn, string_agg(one, ' ' order by k) as out from r where n / 150.0::double * 60.0 <= 15 group by all)
select conv_id, turn, coalesce(out, array_to_string(list_filter(string_split_regex(trim(ss[1]), '\\s+'), lambda x: x <> '')[1:37], ' ')) as spoken from s left join kept using (conv_id, turn)""")
def speech_truncate(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.truncate_to_budget(F.col("text")).alias("spoken"))


_CLIP = "'/clips/query' || lpad((p_partkey % 12)::varchar, 2, '0') || case p_partkey % 3 when 0 then '' when 1 then '_original' else '_' || p_brand end || '.wav'"


@query(f"select p_partkey, split_part(stem, '_', 1) as query, case when regexp_extract(stem, '^[^_]*_(.+)$', 1) in ('', 'original') then 'original' else regexp_extract(stem, '^[^_]*_(.+)$', 1) end as speaker from (select p_partkey, regexp_replace(string_split({_CLIP}, '/')[-1], '\\.[^.]*$', '') as stem from part)")
def audio_name_parse(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("/clips/query"), F.lpad((k % 12).cast("string"), 2, "0"), F.when(k % 3 == 0, "").when(k % 3 == 1, "_original").otherwise(F.concat(F.lit("_"), F.col("p_brand"))), F.lit(".wav"))
    asked_for, speaker = T.audio_name(path)
    return table(spark, d, "part").select("p_partkey", asked_for.alias("query"), speaker.alias("speaker"))


def references(spark, d) -> DataFrame:
    """What was to be said: the first turn of every conversation, read plainly; the second, in another voice."""
    turns = table(spark, d, "conversations").filter("turn < 2")
    return turns.select(F.when(F.col("turn") == 0, "prototype").otherwise("voicemod").alias("dataset"), F.concat(F.lit("query"), F.col("conv_id").cast("string")).alias("query"), F.col("text").alias("reference"))


def transcripts(spark, d) -> DataFrame:
    """What was heard: every turn, as a clip of its conversation's query in its role's voice; some were not understood at all."""
    speaker = F.when(F.col("role") == "user", "original").otherwise(F.col("role"))
    path = F.concat(F.lit("/clips/query"), F.col("conv_id").cast("string"), F.lit("_"), speaker, F.lit(".wav"))
    return table(spark, d, "conversations").select("conv_id", "turn", path.alias("path"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"))


_HEARD = """select c.conv_id, c.turn, case when c.role = 'user' then 'original' else c.role end as speaker, r.text as reference, case when c.turn % 4 <> 3 then c.text else r.text end as text, case when c.turn % 4 <> 3 then 'asr' when r.text is not null then 'fallback-reference' end as model
from conversations c left join conversations r on r.conv_id = c.conv_id and r.turn = case when c.role = 'user' then 0 else 1 end"""


def heard(spark, d) -> DataFrame:
    return asr.with_fallback(asr.with_reference(transcripts(spark, d), references(spark, d)), allow=True)


@query(f"select conv_id, turn, speaker, model, md5(reference) as reference, md5(text) as text from ({_HEARD})")
def asr_reference_join(spark, d) -> DataFrame:
    """Each transcript with the reference of the set its file name points to, and the stand-in where there is none."""
    return heard(spark, d).select("conv_id", "turn", "speaker", "model", F.md5(F.col("reference").cast("binary")).alias("reference"), F.md5(F.col("text").cast("binary")).alias("text"))


def rated(spark, d) -> DataFrame:
    return asr.with_error_rate(heard(spark, d).filter("reference is not null"))


_FORMS = "trim(lower(coalesce({0}, '')))"
for _old, _new in T.SPOKEN_FORMS:
    _FORMS = f"replace({_FORMS}, '{_old}', '{_new}')"
_NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FORMS}, '[-–—]', ' ', 'g'), '[’'']', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")

#: A row of the table of distances in each step: its first number, then each number from the row before and the one beside it.
_WORDS_OF = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_RATED = f"""with recursive h as ({_HEARD}),
q as materialized (select conv_id, turn, speaker, {_WORDS_OF.format('a')} as a, {_WORDS_OF.format('b')} as b from (select conv_id, turn, speaker, {_NORMAL.replace('{0}', 'reference')} as a, {_NORMAL.replace('{0}', 'text')} as b from h where reference is not null)),
d(conv_id, turn, i, r) as (select conv_id, turn, 0, list_transform(range(0, len(b) + 1), lambda j: j) from q union all
select d.conv_id, d.turn, i + 1, list_reduce(list_transform(range(1, len(b) + 2), lambda j: [case when j = 1 then i + 1 else least(r[j] + 1, r[j - 1] + (a[i + 1] <> b[j - 1])::int) end]), lambda x, y: list_append(x, least(y[1], x[len(x)] + 1)))
from d join q using (conv_id, turn) where i < len(a)),
rated as (select conv_id, turn, speaker, case when len(a) > 0 then r[len(b) + 1] / len(a)::double else (len(b) > 0)::int::double end as wer from d join q using (conv_id, turn) where i = len(a))"""


@query(f"{_RATED} select speaker, count(*) as n, round(avg(wer), 6) as wer from rated group by speaker")
def wer_by_group(spark, d) -> DataFrame:
    return asr.mean_error_rate(rated(spark, d), "speaker")


@query(f"{_RATED} select count(*) as n, round(avg(wer), 6) as wer from rated")
def wer_overall(spark, d) -> DataFrame:
    return asr.mean_error_rate(rated(spark, d))


@query(f"{_RATED} select conv_id, turn, round(wer, 6) as wer from rated where speaker <> 'original' and wer > 0.9")
def asr_errors(spark, d) -> DataFrame:
    """Transcripts of the other voices that differ much from their reference."""
    return rated(spark, d).filter("dataset = 'voicemod' and wer > 0.9").select("conv_id", "turn", F.round("wer", 6).alias("wer"))


_N_ITEMS = "(select count(*) from benchmark)"
_HITS = f"""select item_id as query, doc_id % 3 as voice, term, contains(said, {_NORMAL.replace('{0}', 'term')}) as recognized from (select doc_id, doc_id % {_N_ITEMS} as item_id, {_NORMAL.replace('{0}', 'text')} as said from documents)
join (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as term from benchmark) using (item_id)"""


def term_hits(spark, d) -> DataFrame:
    """Every document stands in for a transcript of one query, and the words of that query are the terms it should hold."""
    items = table(spark, d, "benchmark")
    n = items.count()
    terms = items.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    said = docs(spark, d).select("doc_id", "text", (F.col("doc_id") % n).alias("query"), (F.col("doc_id") % 3).alias("voice"))
    return asr.term_hits(said, terms)


@query(f"select query, count(*) as n, round(avg(recognized::int), 6) as accuracy from ({_HITS}) group by query")
def term_accuracy(spark, d) -> DataFrame:
    return asr.accuracy(term_hits(spark, d), "query")


@query(f"select voice, count(*) as n, round(avg(recognized::int), 6) as accuracy from ({_HITS}) group by voice")
def term_accuracy_by_voice(spark, d) -> DataFrame:
    return asr.accuracy(term_hits(spark, d), "voice")


@query(f"select count(*) as n, round(avg(recognized::int), 6) as accuracy from ({_HITS})")
def term_accuracy_overall(spark, d) -> DataFrame:
    return asr.accuracy(term_hits(spark, d))


@query(f"select term, count(*) as misses from ({_HITS}) where not recognized group by term")
def term_misses(spark, d) -> DataFrame:
    return asr.misses(term_hits(spark, d), "term")


@query(f"select voice, count(*) as misses from ({_HITS}) where not recognized group by voice")
def term_misses_by_voice(spark, d) -> DataFrame:
    return asr.misses(term_hits(spark, d), "voice")


ANSWERS = f"""{LEXICAL}, r as ({RANKED.format('bm', 5)}), top as (select qid, count(*) as n, arg_min(doc_id, rank) as doc_id from r group by qid),
a as (select item_id as qid, top.doc_id, 'document ' || top.doc_id as title, n_chars / 100.0::double as price, coalesce(n, 0) - 1 as others from benchmark left join top on qid = item_id left join documents using (doc_id))"""
_SPOKEN = "'The best match is ' || title || ' at $' || printf('%.2f', price) || '. It was compared with ' || others || ' others. Sources are on screen. Should it be cheaper, or better rated?'"


@query(f"""{ANSWERS}, f as (select *, qid % 3 = 0 as flagged, (qid % 4)::int as made_up, qid % 5 = 0 as blocked from a)
select qid, doc_id, case when flagged then '{answer.CAUTION}' else '' end || case when title is null then '{answer.NOTHING}' else {_SPOKEN} end as speech, case when blocked then 'reject' when made_up = 1 then 'revise' else 'accept' end as action from f""")
def answer_turn(spark, d) -> DataFrame:
    """Search, answer and critic of each query; some turns have hazards, made-up citations, or are blocked."""
    found = lexical.bm25(asked(spark, d), stored(spark, d), top=5)
    top = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", "rank").alias("doc_id"))
    rows = asked(spark, d).select("qid").join(top, "qid", "left").join(docs(spark, d).select("doc_id", (F.col("n_chars") / 100.0).alias("price")), "doc_id", "left")
    speech = answer.spoken_answer(F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.col("price"), F.lit(None).cast("double"), F.coalesce("n", F.lit(0)) - 1)
    k = F.col("qid")
    hazards = F.when(k % 3 == 0, F.array(F.lit("mixed"))).otherwise(F.array().cast("array<string>"))
    action = answer.verdict(k % 5 == 0, F.when(k % 4 == 1, 1).otherwise(0), F.size(hazards), F.lit(0))
    return rows.select("qid", "doc_id", answer.cautioned(speech, hazards).alias("speech"), action.alias("action"))


_MESSAGES = f"""select conv_id, turn, length(text) as ms, concat_ws(',', case when n = 0 then 'no speech' end, case when n / 150.0::double * 60 > 15 then 'over budget' end, case when role = 'system' and turn % 2 = 1 then 'bad action' end, case when turn % 5 = 4 then 'uncited row' end,
case when role = 'system' and turn % 3 = 0 then 'spoken before accept' end, case when turn % 6 = 3 then 'no audio file' end) as messages from (select *, {_N.format('text')} as n from conversations)"""


def cases(spark, d) -> DataFrame:
    action, k = F.when(F.col("role") == "system", "reject").otherwise("accept"), F.col("turn")
    found = evaluate.invariants(T.speech_seconds(F.col("text")), action, F.when(k % 5 == 4, 1).otherwise(0), F.lit(1), k % 2 == 0, spoken=k % 3 == 0, audio=k % 6 != 3)
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("messages"), F.length("text").alias("wall_ms"))


@query(f"select conv_id, turn, messages from ({_MESSAGES})")
def e2e_invariants(spark, d) -> DataFrame:
    return cases(spark, d).select("conv_id", "turn", F.array_join("messages", ",").alias("messages"))


@query(f"select count(*) as n_cases, count(*) filter (where messages = '') as n_passed, count(*) filter (where messages <> '') as n_failed, round(avg(ms))::bigint as mean_wall_ms from ({_MESSAGES})")
def e2e_summary(spark, d) -> DataFrame:
    return evaluate.case_summary(cases(spark, d))


@query("select conv_id as trace_id, '# Steps' || chr(10) || chr(10) || string_agg('## ' || turn || '. ' || upper(role[1]) || role[2:] || ' (' || length(text) || ' ms)', chr(10) || chr(10) order by turn) as markdown from conversations group by conv_id")
def trace_markdown(spark, d) -> DataFrame:
    return turn.markdown(steps(spark, d))


@query("select event_id, fingerprint, coalesce(fingerprint <> lag(fingerprint) over (partition by user_id order by event_id), true) as changed from (select *, sha256(event_type) as fingerprint from events)")
def input_changes(spark, d) -> DataFrame:
    """Whether a user's input differs from the one before."""
    return asr.changed(events(spark, d), "user_id", "event_id", F.col("event_type")).select("event_id", "fingerprint", "changed")


# -- live search and provider state ----------------------------------------------------------

_MODE = " ".join(f"when '{k}' then {_candidates(v)}" for k, v in routing.MODES.items())
_NEAR, _CONFIGURED, _TRIED = "['brave']", "list_filter(['exa', 'tavily', 'brave', 'linkup', 'gemini'], lambda p: conv_id % 2 = 0 or p <> 'gemini')", "case when turn % 4 = 2 then ['tavily', 'exa'] when (conv_id + turn) % 10 = 9 then ['exa', 'tavily', 'brave', 'linkup', 'gemini'] else []::varchar[] end"
_PICK = "coalesce(list_filter(case mode {modes} end, lambda p: not list_contains({out}, p) and list_contains(configured, p) and not list_contains({near}, p))[1], list_filter({last}, lambda p: not list_contains({out}, p) and list_contains(configured, p))[1], 'tavily')"
_pick = lambda out: _PICK.format(modes=_MODE, out=out, near=_NEAR, last=_candidates(()))
_left = lambda out: f"nullif({_pick(out)}, case when list_contains({out}, {_pick(out)}) then {_pick(out)} end)"
#: In the stand-in, exa fails for some queries, and linkup can't be loaded at all.
_DOWN = "provider = 'exa' and slot % 10 = 3"
_CALLS = f"""with r as (select conv_id, turn, ['{"', '".join(routing.MODES)}'][1 + (conv_id + turn) % {len(routing.MODES)}] as mode, {_CONFIGURED} as configured, {_TRIED} as excluded, (conv_id * 7 + turn) % 50 as slot from conversations where role = 'user'),
c1 as (select *, {_left('excluded')} as first from r), c2 as (select *, case when first = 'linkup' then list_concat(excluded, ['linkup']) else excluded end as out from c1),
c as (select * exclude (first), case when first = 'linkup' then {_left('out')} else first end as provider from c2),
p as (select *, {_pick('list_concat(excluded, [provider])')} as next from c),
o as (select [{", ".join(f"'{x}'" for x in routing.LAST_RESORT)}][1 + page_id % 6] as provider, page_id % 50 as slot, page_id, case when page_id % 4 = 1 then 'answer ' || page_id else '' end as answer, url from pages),
f as (select p.*, o.page_id, o.answer, o.url, row_number() over (partition by conv_id, turn order by o.page_id) as n from p join o on o.provider = p.provider and o.slot = p.slot and not ({_DOWN.replace("provider", "p.provider").replace("slot", "p.slot")}) qualify n <= 10),
g as (select conv_id, turn, count(*) as n, arg_min(answer, page_id) filter (where answer <> '') as answer, string_agg(url, ' ' order by page_id) as urls from f group by all),
h as (select p.*, conv_id * 1000 + turn as request_id, coalesce(n, 0) as count, answer, coalesce(urls, '') as urls, provider is not null and coalesce(n, 0) < 3 as thin from p left join g using (conv_id, turn))"""


def live_requests(spark, d) -> DataFrame:
    k, modes = F.col("conv_id"), F.array(*map(F.lit, routing.MODES))
    gone = F.when(F.col("turn") % 4 == 2, F.array(F.lit("tavily"), F.lit("exa"))).when((k + F.col("turn")) % 10 == 9, F.array(*map(F.lit, ["exa", "tavily", "brave", "linkup", "gemini"])))
    return table(spark, d, "conversations").filter("role = 'user'").select(
        (k * 1000 + F.col("turn")).alias("request_id"), F.get(modes, ((k + F.col("turn")) % len(routing.MODES)).cast("int")).alias("mode"), F.concat(F.lit("slot "), ((k * 7 + F.col("turn")) % 50).cast("string")).alias("query"),
        F.filter(F.array(*map(F.lit, ["exa", "tavily", "brave", "linkup", "gemini"])), lambda p: (k % 2 == 0) | (p != "gemini")).alias("configured"), F.array(F.lit("brave")).alias("near"), gone.alias("excluded"),
    )


def page_providers(n_pages: int) -> dict:
    """Stand-ins for search providers, which are called: each has every sixth page, by number, and finds those of a slot."""

    def loading(place: int, name: str):
        def load():
            if name == "linkup":
                raise KeyError("no key")

            def search(query, most, mode):
                slot = int(query.removeprefix("slot "))
                if name == "exa" and slot % 10 == 3:
                    raise ConnectionError("down")
                return ({"title": "page", "url": f"page:{n}", "score": 1, "answer": f"answer {n}" if n % 4 == 1 else ""} for n in range(slot, n_pages, 50) if n % 6 == place)

            return search

        return load

    return {name: loading(place, name) for place, name in enumerate(routing.LAST_RESORT)}


def _with_urls(spark, d, found: DataFrame) -> DataFrame:
    """Responses with the urls of the pages that their sources name."""
    named = found.select("request_id", F.posexplode("sources.url").alias("n", "name"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("name"), "url")
    urls = named.join(pages, "name").groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]), " ").alias("urls"))
    return found.join(urls, "request_id", "left").withColumn("urls", F.coalesce("urls", F.lit("")))


def _searched(spark, d):
    return dispatch.live_search(live_requests(spark, d), page_providers(table(spark, d, "pages").count()))


@query(f"""{_CALLS} select request_id, mode, provider as provider_used, case when {_DOWN} then 'failed' when provider is not null then 'ok' end as status, count, answer, urls, thin as can_escalate, case when thin then next end as escalate_to, case when provider is null then 'no provider' end as error from h""")
def live_search(spark, d) -> DataFrame:
    """Search composed: provider by mode, configuration, exclusions and quota, its call, results, answer, escalation."""
    found, _ = _searched(spark, d)
    return _with_urls(spark, d, found).select("request_id", "mode", "provider_used", "status", "count", "answer", "urls", "can_escalate", "escalate_to", "error")


@query(f"""{_CALLS}, e1 as (select conv_id, turn, mode, configured, slot, list_distinct(list_concat(excluded, [provider])) as excluded from h where thin), e2 as (select *, {_left('excluded')} as first from e1),
e3 as (select *, case when first = 'linkup' then list_concat(excluded, ['linkup']) else excluded end as out from e2), e as (select * exclude (first), case when first = 'linkup' then {_left('out')} else first end as provider from e3),
found as (select conv_id, turn, least(count(o.page_id), 10) as n from e left join o on o.provider = e.provider and o.slot = e.slot and not ({_DOWN.replace("provider", "e.provider").replace("slot", "e.slot")}) group by all)
select conv_id * 1000 + turn as request_id, provider as provider_used, n as count, case when provider is null then 'no provider' end as error, array_to_string(list_sort(excluded), ',') as tried from e join found using (conv_id, turn)""")
def live_escalate(spark, d) -> DataFrame:
    """Thin responses once more, at the next provider that wasn't tried."""
    found, _ = _searched(spark, d)
    again = dispatch.escalation(found, live_requests(spark, d))
    more, _ = dispatch.live_search(again, page_providers(table(spark, d, "pages").count()))
    return more.select("request_id", "provider_used", "count", "error", F.array_join(F.array_sort("previously_tried"), ",").alias("tried"))


@query(f"""{_CALLS} select provider, case when {_DOWN} then 'failed' else 'ok' end as status, count(*) as calls, sum(count)::bigint as hits from h where provider is not null group by all""")
def live_calls(spark, d) -> DataFrame:
    """What the request log measured of the calls: how they ended, and their hits."""
    _, made = _searched(spark, d)
    log = dispatch.request_log(made).withColumn("f", F.from_json("filters", "mode string, provider string, status string")).filter("ms >= 0 and f.status <> 'unavailable'")
    return log.groupBy(F.col("f.provider").alias("provider"), F.col("f.status").alias("status")).agg(F.count(F.lit(1)).alias("calls"), F.sum("hits").cast("long").alias("hits"))


@query(f"""select provider, 'slot ' || slot as query, n - 1 as ord, url from (
select [{", ".join(f"'{x}'" for x in routing.LAST_RESORT)}][1 + page_id % 6] as provider, page_id % 50 as slot, page_id, url, row_number() over (partition by page_id % 6, page_id % 50 order by page_id) as n from pages)
where provider in ('tavily', 'brave') and n <= 10 and timestamp '2024-01-01' + page_id * interval 1 hour >= timestamp '2024-01-02'""")
def search_source(spark, d) -> DataFrame:
    """Providers as a data source: filters choose which of them are called, for what, and go along as hints."""
    from ..sources.providers import register

    def service(load):
        return lambda query, k, mode: [r | {"published": datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=int(r["url"][5:]))} for r in islice(load()(query, k, mode), k)]

    register(spark, "pages", {name: service(load) for name, load in page_providers(table(spark, d, "pages").count()).items()})
    found = spark.read.format("search-pages").option("query", "\n".join(f"slot {n}" for n in range(50))).option("k", 10).load()
    found = found.filter("provider in ('tavily', 'brave') and mode = 'search' and published >= timestamp'2024-01-02 00:00:00'")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("page"))
    return found.join(pages, F.col("url") == F.col("name")).select("provider", "query", F.col("ord").cast("long").alias("ord"), F.col("page").alias("url"))


# -- grounded answers: a conversation is an answer, its turns the pages found and the parts that rest on them --

_CHUNK = "case when turn % 5 <> 4 then 'u' || (length(text) % {0} + {1}) end"


def _placed(n: int, plus: int, name: str) -> str:
    return f"""{name}_c as (select conv_id, uri, min(turn) as t, arg_min(role, turn) as title from (select conv_id, turn, role, {_CHUNK.format(n, plus)} as uri from conversations) where uri is not null group by conv_id, uri),
{name}_p as (select *, row_number() over (partition by conv_id order by t) - 1 as place from {name}_c),
{name}_s as (select conv_id, ref, arg_min(text, turn) as text from (select conv_id, turn, text, unnest([turn % 4, (turn + 2) % 9]) as ref from conversations where text <> '') group by conv_id, ref),
{name} as (select p.conv_id, place, title, uri as url, coalesce(substr(text, 1, 200), '') as snippet from {name}_p p left join {name}_s s on s.conv_id = p.conv_id and s.ref = p.place)"""


def answers(spark, d, n: int, plus: int) -> DataFrame:
    uri = F.when(F.col("turn") % 5 != 4, F.concat(F.lit("u"), (F.length("text") % n + plus).cast("string")))
    refs = F.array((F.col("turn") % 4).cast("int"), ((F.col("turn") + 2) % 9).cast("int"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("turn", uri.alias("uri"), F.col("role").alias("title"), "text", refs.alias("refs")))).alias("t"))
    return rows.select("request_id", F.concat(F.lit("answer "), F.col("request_id").cast("string")).alias("answer"), F.transform("t", lambda t: F.struct(t["uri"].alias("uri"), t["title"].alias("title"))).alias("chunks"), F.transform("t", lambda t: F.struct(t["text"].alias("text"), t["refs"].alias("refs"))).alias("supports"))


@query(f"""with {_placed(7, 0, 'found')} select conv_id as request_id, place::int as ord, title, url, snippet, 0.75::double as score, case when place = 0 then 'answer ' || conv_id end as answer from found where place < 5
union all select conv_id, 0, 'Answer', '', 'answer ' || conv_id, 0.7::double, 'answer ' || conv_id from (select distinct conv_id from conversations) where conv_id not in (select conv_id from found)""")
def grounded_sources(spark, d) -> DataFrame:
    """Sources of each answer, with the part of the answer that rests on them."""
    return grounding.grounded(answers(spark, d, 7, 0))


@query(f"""with {_placed(3, 0, 'one')}, {_placed(5, 2, 'two')}, thin as (select conv_id from (select distinct conv_id from conversations) left join (select conv_id, count(*) as n from one group by all) using (conv_id) where coalesce(n, 0) < 4),
every as (select *, 0 as round from one union all select *, 1 from two where conv_id in (select conv_id from thin) and (conv_id, url) not in (select conv_id, url from one))
select conv_id as request_id, (row_number() over (partition by conv_id order by round, place) - 1)::int as ord, title, url, snippet, 0.75::double as score from every qualify row_number() over (partition by conv_id order by round, place) <= 4""")
def grounded_rounds(spark, d) -> DataFrame:
    """Research in two rounds: the second one for requests with few sources, and only what it adds."""
    requests = table(spark, d, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    return grounding.researched(requests, lambda asked, k: answers(spark, d, *((3, 0), (5, 2))[k]).join(asked.select("request_id"), "request_id", "left_semi"), most=4)


@query(f"""select provider, coalesce(case when provider = 'click' then ever else in_month end, 0)::bigint as calls, call_limit, case when call_limit > 0 then coalesce(case when provider = 'click' then ever else in_month end, 0) >= 0.95::double * call_limit else false end as near
from (values {", ".join(f"('{k}', {n or 'null'}::bigint)" for k, (n, _) in [*LIMITS.items(), ('idle', (10, 'monthly'))])}) l(provider, call_limit)
left join (select event_type as provider, count(*) as ever, count(*) filter (where strftime(ts, '%Y-%m') = '2024-01') as in_month from events group by all) using (provider)""")
def usage_backfill(spark, d) -> DataFrame:
    """Every known provider's calls of the month, or ever; one that was never called has none."""
    from ..sources.sinks import usage_now

    used = usage_now(events(spark, d).withColumnRenamed("event_type", "provider"), F.lit("2024-01"), {**LIMITS, "idle": (10, "monthly")})
    near = routing.near_limit_now(used).withColumn("near", F.lit(True))
    return used.join(near, "provider", "left").select("provider", "calls", "call_limit", F.coalesce("near", F.lit(False)).alias("near"))


@query(f"""with recursive o as (select event_id, user_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
f as (select user_id, event_type, n, event_id, t, t as opened, false as hit from o where n = 1 union all select o.user_id, o.event_type, o.n, o.event_id, o.t, case when o.t < f.opened + {TTL}::bigint * 1000000 then f.opened else o.t end, o.t < f.opened + {TTL}::bigint * 1000000
from f join o on o.user_id = f.user_id and o.event_type = f.event_type and o.n = f.n + 1)
select event_id as call_id, n * 60000000 + max(t - n * 60000000) over (partition by user_id order by t, event_id rows unbounded preceding) as start from (select event_id, user_id, t, row_number() over (partition by user_id order by t, event_id) as n from f where not hit)""")
def throttle_misses(spark, d) -> DataFrame:
    """Only calls that the cache can't answer wait for their turn."""
    calls = state.cached(events(spark, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], TTL, "event_id").filter(~F.col("hit"))
    return state.throttle(calls.select("user_id", F.col("event_id").alias("call_id"), F.unix_micros("ts").alias("at")), 60_000_000, ["user_id"]).select("call_id", "start")


# -- whole turns ----------------------------------------------------------------------------

TURN_OUT, TURN_IN, TURN_LIVE = ["zz", "shea"], ["the", " la ", " de ", "und", "e"], ["tion"]
HAZARD, INJECTION = {"mixed": [["onen", "ver", "de"], ["match"]]}, {"der": PATTERNS["der"]}


def turn_route(turns: DataFrame) -> DataFrame:
    """The router, with the constraints that a turn's number stands for."""
    k = F.col("qid") % 5
    return routing.route(turns, TURN_OUT, TURN_IN, ECO, TURN_LIVE, material="zzz").withColumns({"price_max": F.when(k == 2, F.lit(20.0)).when(k == 4, F.lit(0.001)), "brand": F.when(k == 1, F.lit("EN"))})


def made_up(rows: DataFrame, attempt: int) -> DataFrame:
    """An answerer that cites what was not found in every third turn, and mends half of those when asked again."""
    out = turn.offline_answer(rows, attempt)
    wrong = (F.col("qid") % 3 == 0) if attempt == 0 else (F.col("qid") % 6 == 3)
    return out.withColumn("table_ids", F.when(wrong, F.concat("table_ids", F.array(F.lit("none")))).otherwise(F.col("table_ids")))


def _turn_sql() -> str:
    from .retrieval import META, fused_sql, hashed_sql, lexical_sql

    low, words = "lower(text)", _WORDS.replace("trim(low)", "trim(text)")
    any_of = lambda terms: "(" + " or ".join(f"contains({low}, '{t}')" for t in terms) + ")"
    start = lambda terms, x: f"regexp_matches(lower({x}), '{_START}({'|'.join(terms)})')"
    hazard = lambda x: "(" + " and ".join(start(g, x) for g in HAZARD["mixed"]) + ")"
    planned = f"""select item_id as qid, text, {words} as words, regexp_matches(text, '(?is){INJECTION['der']}') as injected, {hazard('text')} as hazard, {any_of(TURN_OUT)} or not {any_of(TURN_IN)} as away, {any_of(TURN_LIVE)} as wants from benchmark"""
    plan = f"""select qid, text, case when len(words) > 0 then array_to_string(words[1:7], ' ') else 'cleaner' end as query, case when injected or hazard then 'blocked' when away then 'out_of_catalog' else 'product_recommendation' end as task,
case when injected then 'prompt_injection:der' else 'mixed' end as flag, wants, case when qid % 5 = 1 then 'en' end as brand, case when qid % 5 = 2 then 20.0::double when qid % 5 = 4 then 0.001::double end as price_max from ({planned})"""
    ok = "(p.brand is null or coalesce(lower(meta.brand) = p.brand, false)) and (p.price_max is null or coalesce(price between 0 and p.price_max, false))"
    searched = f"select qid, query as text from ({plan}) where task = 'product_recommendation'"
    return f"""{lexical_sql(searched)}{hashed_sql(searched)}{META}, p as ({plan}), dense_f as (select dense.* from dense join p using (qid) join meta using (doc_id) where {ok}), bm_f as (select bm.* from bm join p using (qid) join meta using (doc_id) where {ok})
{fused_sql('dense_f', 'bm_f', 'strict')}{fused_sql()}, every as (select qid, doc_id, fused, false as relaxed from strict union all select qid, doc_id, fused, true from fused where qid in (select qid from p where brand is not null or price_max is not null) and qid not in (select qid from strict)),
top as (select *, row_number() over (partition by qid order by fused desc, doc_id) as rank from every qualify rank <= 3), g as (select qid, count(*) as n_private, bool_or(relaxed) as relaxed, arg_min(doc_id, rank) as doc_id, string_agg(category, ' ' order by rank) as ingredients from top join meta using (doc_id) group by qid),
s as (select p.*, coalesce(n_private, 0) as n_private, coalesce(relaxed, false) as relaxed, task <> 'blocked' and (task = 'out_of_catalog' or wants) as live, g.doc_id, coalesce(g.ingredients, ' ') as ingredients, round(price, 2) as price, round(rating, 2) as rating from p left join g using (qid) left join meta using (doc_id)),
b as (select *, case when live then 2 else 0 end as n_live, case when live then 1 else 0 end as n_blocked from s),
w as (select *, case when task = 'blocked' then '' when n_private > 0 then 'The best match is document ' || doc_id || ' at $' || printf('%.2f', price) || coalesce(', rated ' || rating::varchar, '') || '. It was compared with ' || (n_private - 1) || ' others. Sources are on screen. Should it be cheaper, or better rated?'
when n_live > 0 then 'The best match is offer 0 at $9.50. It was compared with 1 others. Sources are on screen. Should it be cheaper, or better rated?' else '{answer.NOTHING}' end as said from b),
h as (select *, task <> 'blocked' and {hazard("text || ' ' || said || ' ' || ingredients")} as unsafe from w)
select qid, task, case when task = 'blocked' then '' when task = 'out_of_catalog' then 'web' when wants then 'private,web' else 'private' end as sources, n_private, relaxed, n_live::bigint as n_live, n_blocked::bigint as n_blocked, case when n_private > 0 then n_live else 0 end::bigint as n_unmatched,
case when task = 'blocked' then case when flag = 'mixed' then '{turn.BLOCKED[False]}' else '{turn.BLOCKED[True].replace("'", "''")}' end when unsafe then '{answer.CAUTION}' || said else said end as speech,
case when task = 'blocked' then 'reject' when qid % 6 = 3 then 'revise' else 'accept' end as action, task = 'blocked' or unsafe as unsafe, task = 'blocked' or qid % 6 <> 3 as grounded, case when task <> 'blocked' and qid % 3 = 0 then 1 else 0 end as revisions,
concat_ws('>', 'router', 'planner', case when task = 'product_recommendation' then 'private_search' end, case when live then 'live_search' end, case when task <> 'blocked' then 'reconcile' end, 'answer', case when task <> 'blocked' and qid % 3 = 0 then 'answer_again' end, case when task <> 'blocked' and qid % 6 <> 3 then 'speak' end) as steps from h"""


@query(_turn_sql())
def turn_end_to_end(spark, d) -> DataFrame:
    """Whole turns: guard, route, plan, search with a relaxed retry, live results, reconciliation, answer, critic, second answer."""
    offer = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord")
    live = asked(spark, d).select("qid", offer).select(
        "qid", "ord", F.concat(F.lit("offer "), F.col("ord").cast("string")).alias("title"), F.concat(F.lit("https://"), F.when(F.col("ord") == 1, "bad.test").otherwise("shop.example.com"), F.lit("/p")).alias("url"),
        F.lit("x").alias("snippet"), (F.col("ord") + 9.5).alias("price"), F.lit("in stock").alias("availability"),
    )
    rows = turn.run(asked(spark, d), stored(spark, d), live, turn_route, made_up, HOSTS, HAZARD, INJECTION)
    kept = ["qid", "task", "sources", "n_private", "relaxed", "n_live", "n_blocked", "n_unmatched", "speech", "action", "unsafe", "grounded", "revisions"]
    return rows.select(*kept, F.array_join("steps", ">").alias("steps"))


@query("select event_type as provider, strftime(ts, '%Y-%m') as month, count(*) as calls from events group by all")
def stream_usage_monthly(spark, d) -> DataFrame:
    from ..streaming.state import event_stream, monthly_usage

    return monthly_usage(event_stream(spark, d, "event_type").withColumnRenamed("event_type", "provider"))


@query(f"""with recursive o as (select user_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id, event_type order by ts) as n from events),
f as (select user_id, event_type, n, t as opened, 0::bigint as hits from o where n = 1 union all select o.user_id, o.event_type, o.n, case when o.t < f.opened + {TTL}::bigint * 1000000 then f.opened else o.t end, f.hits + (o.t < f.opened + {TTL}::bigint * 1000000)::bigint
from f join o on o.user_id = f.user_id and o.event_type = f.event_type and o.n = f.n + 1)
select user_id, event_type, arg_max(hits, n) as hits, max(n) - arg_max(hits, n) as misses from f group by all""")
def stream_ttl_cache(spark, d) -> DataFrame:
    from ..streaming.state import cached_requests, event_stream

    rows = cached_requests(event_stream(spark, d, "user_id", "event_type").withColumnRenamed("event_id", "id"), ["user_id", "event_type"], TTL)
    return rows.groupBy("user_id", "event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""select event_id as call_id, n * 60000000 + max(t - n * 60000000) over (partition by user_id order by t, event_id rows unbounded preceding) as start
from (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events)""")
def stream_throttle(spark, d) -> DataFrame:
    from ..streaming.state import event_stream, throttled

    return throttled(event_stream(spark, d, "user_id").withColumnRenamed("event_id", "id"), ["user_id"], 60_000_000).select(F.col("id").alias("call_id"), "start")
