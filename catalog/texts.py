"""Grounding, contract, case and scrub checks over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog.decisions import DECISION
from catalog.fixtures import once, supplier_run, supplier_series, table, with_
from catalog.modelling import long, rounded
from keycast.functions.skew import spread, stable, widen
from keycast.functions.text import cap_words
from keycast.operators import series as series_ops
from keycast.operators import textcheck

WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def WORDS(x):
    return rf"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def STRIP(x):
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def SENTENCES(x):
    cut = rf"string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {STRIP('s')}), lambda s: s <> '')"


# -- grounding: documents checked against numbers known about them -------------------------

_FACTS = "facts AS (SELECT doc_id, text, [CAST(n_chars AS DOUBLE), CAST(doc_id AS DOUBLE), n_chars / 19997.0] AS known FROM documents)"
_TWINS = """numbers AS (SELECT *, list_distinct(list_filter(flatten(list_transform(known, lambda v: [round(v, 4), CASE WHEN abs(v) <= 1 THEN round(v * 100, 4) WHEN abs(v) <= 1000 THEN round(v / 100, 6) END])), lambda v: v IS NOT NULL)) AS f FROM facts),
cited AS (SELECT *, list_transform(list_filter(list_transform(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?%?'), lambda x: rtrim(x, '%')), lambda x: NOT (regexp_full_match(x, '-?\\d+') AND abs(CAST(x AS DOUBLE)) <= 12)), lambda x: CAST(x AS DOUBLE)) AS c FROM numbers),
judged AS (SELECT *, len(c) AS checked_numbers, len(list_filter(c, lambda x: NOT list_bool_or(list_transform(f, lambda v: abs(x - v) <= greatest(0.6, abs(v) * 0.03))))) AS ungrounded FROM cited)""".replace("\\\\", "\\")


def fact_documents(spark, sf) -> DataFrame:
    known = F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"), F.col("n_chars") / F.lit(19997.0))
    return widen(table(spark, sf, "documents")).select("doc_id", "text", known.alias("known"))


@query("text_citable_numbers", with_(_FACTS, _TWINS) + "SELECT doc_id, unnest(f) AS fact FROM numbers")
def _(spark, sf):
    return fact_documents(spark, sf).select("doc_id", F.explode(textcheck.citable_numbers(F.col("known"))).alias("fact"))


@query("text_grounding", with_(_FACTS, _TWINS) + "SELECT doc_id, checked_numbers, ungrounded, ungrounded = 0 AS grounded FROM judged")
def _(spark, sf):
    out = textcheck.grounding(fact_documents(spark, sf), "text", "known")
    return out.select("doc_id", *long("checked_numbers", "ungrounded"), "grounded")


# -- response contract: conversation turns read as raw responses -------------------------------

_FIELDS = "selected_model", "rejection_reasons", "confidence", "caveats", "concise_summary"


def responses(spark, sf) -> DataFrame:
    """JSON built from each turn; what breaks the contract depends on the turn itself."""
    conv = table(spark, sf, "conversations")
    n = F.length("text")
    parts = F.filter(F.split("text", r"\. "), lambda s: s != "")
    good = F.to_json(F.struct(
        F.when(F.col("turn") == 0, F.lit("arima")).otherwise(F.lit("prophet")).alias("selected_model"), parts.alias("rejection_reasons"),
        (n / F.lit(10.0)).alias("confidence"), F.array(F.lit("short history")).alias("caveats"), F.col("text").alias("concise_summary"),
    ))
    odd = F.concat(F.lit('{"selected_model": 5, "confidence": "x", "caveats": "none", "turn": '), F.col("turn").cast("string"), F.lit("}"))
    raw = F.when(n < 60, F.substring("text", 1, 20)).when(n < 90, F.lit("[1, 2]")).when(n < 150, odd).when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    return conv.select("conv_id", "turn", F.col("role").alias("prompt_version"), raw.alias("raw"), F.lit("prophet").alias("expected"))


_PARTS = "list_filter(string_split(text, '. '), lambda s: s <> '')"
_CONTRACT = f"""bad AS (SELECT conv_id, turn, role, CASE WHEN length(text) < 60 THEN ['not valid JSON'] WHEN length(text) < 90 THEN ['not a JSON object']
    WHEN length(text) < 150 THEN ['missing: rejection_reasons, concise_summary', 'selected_model must be a non-empty string', 'confidence must be a number or null', 'caveats must be a list of strings', 'concise_summary must be a non-empty string']
    ELSE list_filter([CASE WHEN turn = 0 THEN 'selected_model is not the winner' END, CASE WHEN len({_PARTS}) > 6 THEN 'rejection_reasons has too many entries' END,
    CASE WHEN len(list_filter({_PARTS}, lambda s: len({WORDS('s')}) > 20)) > 0 THEN 'rejection_reasons entry is too long' END, CASE WHEN length(text) / 10.0 > 100 THEN 'confidence is out of range' END,
    CASE WHEN len({WORDS('text')}) > 70 THEN 'concise_summary is too long' END], lambda p: p IS NOT NULL) END AS problems FROM conversations)"""


@query("text_contract_problems", with_(_CONTRACT) + "SELECT conv_id, turn, array_to_string(problems, '; ') AS problems, len(problems) = 0 AS schema_valid FROM bad")
def _(spark, sf):
    out = textcheck.contract_problems(responses(spark, sf), "raw", "expected")
    return out.select("conv_id", "turn", F.array_join("problems", "; ").alias("problems"), "schema_valid")


@query("text_contract_problem_counts", with_(_CONTRACT) + "SELECT role AS prompt_version, problem, count(*) AS responses FROM (SELECT role, unnest(problems) AS problem FROM bad) GROUP BY 1, 2")
def _(spark, sf):
    return textcheck.contract_report(textcheck.contract_problems(responses(spark, sf), "raw", "expected"), "prompt_version")[0]


@query("text_contract_pass_rate", with_(_CONTRACT) + "SELECT role AS prompt_version, count(*) AS responses, round(avg(CASE WHEN len(problems) = 0 THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM bad GROUP BY 1")
def _(spark, sf):
    return textcheck.contract_report(textcheck.contract_problems(responses(spark, sf), "raw", "expected"), "prompt_version")[1]


# -- insight facts and texts for every group of the run ------------------------------------------

_INSIGHT = """told AS (SELECT p.group_id, p.model_name AS selected_model, wmape, fallback_used, round(100 - wmape, 1) AS confidence, n < 24 AS short FROM picked p LEFT JOIN scores USING (group_id, model_name) JOIN (SELECT DISTINCT group_id, n FROM series) USING (group_id))"""


def facts_of(spark, sf) -> DataFrame:
    def build():
        run = supplier_run(spark, sf)
        return stable(textcheck.decision_facts(run.selection, run.scores, series_ops.series_facts(supplier_series(spark, sf))))

    return once(spark, f"facts:{sf}", build)


@query("insight_decision_facts", with_(*DECISION, _INSIGHT) + """SELECT group_id, selected_model, round(wmape, 6) AS wmape, fallback_used, confidence, array_to_string(list_filter([CASE WHEN short THEN 'short history' END, CASE WHEN fallback_used THEN 'fallback model used' END], lambda x: x IS NOT NULL), ', ') AS caveats FROM told""")
def _(spark, sf):
    return facts_of(spark, sf).select("group_id", "selected_model", F.round("wmape", 6).alias("wmape"), "fallback_used", "confidence", F.array_join("caveats", ", ").alias("caveats"))


@query("insight_template_text", with_(*DECISION, _INSIGHT) + """SELECT group_id, CASE WHEN wmape IS NULL THEN 'fallback' ELSE selected_model || ' was selected. Over the backtest its WMAPE is ' || printf('%.2f', wmape) || '%, so expect a miss of some ' || printf('%.0f', wmape) || '% in total volume.' END AS concise_summary FROM told""")
def _(spark, sf):
    out = textcheck.template_insight(facts_of(spark, sf))
    text = F.when(F.contains("concise_summary", F.lit("stands in as fallback")), F.lit("fallback")).otherwise(F.col("concise_summary"))
    return out.select("group_id", text.alias("concise_summary"))


@query("insight_key_reason", with_(*DECISION) + """SELECT k.group_id, CASE WHEN fallback_used THEN 'Fallback model used' WHEN c > 0 THEN 'Outranked ' || c || ' rejected candidate' || CASE WHEN c <> 1 THEN 's' ELSE '' END ELSE 'Highest ranked candidate' END AS key_reason
    FROM picked k LEFT JOIN (SELECT group_id, count(*) FILTER (final_rank < winner_rank) AS c FROM walk GROUP BY 1) USING (group_id)""")
def _(spark, sf):
    out = supplier_run(spark, sf).selection
    count = F.size(F.coalesce("rejected_candidates", F.array().cast(out.schema["rejected_candidates"].dataType)))
    return out.select("group_id", textcheck.key_reason(count, F.col("fallback_used")).alias("key_reason"))


# -- case checks: documents read as summaries ----------------------------------------------------

_CASES = f"""cases AS (SELECT doc_id, text AS summary, split_part(text, ' ', 1) AS selected_model, CASE WHEN source = 'src1' THEN 'other' ELSE ' ' || split_part(text, ' ', 1) END AS said_model, lang AS rejected_model,
    CASE WHEN n_chars > 2000 THEN 'missing trend' ELSE 'odd' END AS reason, [CASE WHEN lang = 'en' THEN 'trend was lost' ELSE 'weak season' END] AS reasons, known FROM facts JOIN documents USING (doc_id, text)),
parts AS (SELECT *, {SENTENCES('summary')} AS s FROM cases),
opened AS (SELECT *, lower(coalesce(s[1], '')) AS first, array_to_string(list_filter(s, lambda x: contains(lower(x), rejected_model)), ' || ') AS naming FROM parts),
checked AS (SELECT *, lower({STRIP('said_model')}) = lower({STRIP('selected_model')}) AS winner_ok, reasons[1] || CASE WHEN naming = '' THEN '' ELSE ' || ' || naming END AS around FROM opened)"""
_KEYWORDS = {
    "excessive_smoothing": ["smooth"], "missing_seasonality": ["season"], "missing_trend": ["trend"], "drift": ["drift", "wasserstein", "statistic", "threshold"], "elimination": ["eliminat"],
    "ranking": ["composite", "rank", "score"], "insufficient_history": ["insufficient", "history", "short"], "validation_failure": ["valid", "fail"],
}


def _cats(x):
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({x}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{c}' END" for c, ws in _KEYWORDS.items()) + "], lambda c: c IS NOT NULL)"


_VERDICT = f"""verdict AS (SELECT c.*, j.ungrounded, contains(lower(around), rejected_model) AND (len({_cats('reason')}) = 0 OR len(list_intersect({_cats('reason')}, {_cats('around')})) > 0) AS rejections_ok,
    len({WORDS('summary')}) AS word_count, list_filter([CASE WHEN len({WORDS('summary')}) > 70 THEN 'too long' END,
    CASE WHEN NOT contains(array_to_string(({WORDS('first')})[1:6], ' '), lower(selected_model)) THEN 'winner not named first' END, CASE WHEN starts_with(first, rejected_model) THEN 'opens with a rejected model' END,
    CASE WHEN regexp_matches(summary, '[{{}}]|"\\s*:\\s*"') THEN 'raw formatting' END, CASE WHEN len(s) <> len(list_distinct(list_transform(s, lambda x: lower(x)))) THEN 'repeated sentence' END], lambda i: i IS NOT NULL) AS issues
    FROM checked c JOIN judged j USING (doc_id)),
graded AS (SELECT *, CASE WHEN NOT winner_ok THEN 'contradictory' WHEN ungrounded > 0 THEN 'unsupported' ELSE 'grounded' END AS category, len(issues) = 0 AS readable FROM verdict)"""
_GRADED = (_FACTS, _TWINS, _CASES, _VERDICT)


def judged_documents(spark, sf) -> DataFrame:
    def build():
        docs = spread(fact_documents(spark, sf), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        first = F.element_at(F.split("text", " "), 1)
        cases = docs.select(
            "doc_id", F.col("text").alias("summary"), first.alias("selected_model"), F.when(F.col("source") == "src1", F.lit("other")).otherwise(F.concat(F.lit(" "), first)).alias("said_model"),
            F.array(F.struct(F.col("lang").alias("model_name"), F.when(F.col("n_chars") > 2000, "missing trend").otherwise("odd").alias("reason"))).alias("rejected"),
            F.array(F.when(F.col("lang") == "en", "trend was lost").otherwise("weak season")).alias("reasons"), F.col("known").alias("metrics"), F.lit(True).alias("schema_valid"),
        )
        return stable(textcheck.judge_cases(cases).select("doc_id", "winner_ok", "rejections_ok", "category", "grounded", "issues", "readable", "word_count", "schema_valid"))

    return once(spark, f"judged:{sf}", build)


@query("text_winner_consistency", with_(*_GRADED) + "SELECT doc_id, winner_ok FROM graded")
def _(spark, sf):
    return judged_documents(spark, sf).select("doc_id", "winner_ok")


@query("text_rejection_accuracy", with_(*_GRADED) + "SELECT doc_id, rejections_ok FROM graded")
def _(spark, sf):
    return judged_documents(spark, sf).select("doc_id", "rejections_ok")


@query("text_hallucination_category", with_(*_GRADED) + "SELECT doc_id, category FROM graded")
def _(spark, sf):
    return judged_documents(spark, sf).select("doc_id", "category")


@query("text_readability", with_(*_GRADED) + "SELECT doc_id, array_to_string(issues, ', ') AS issues, word_count FROM graded")
def _(spark, sf):
    return judged_documents(spark, sf).select("doc_id", F.array_join("issues", ", ").alias("issues"), *long("word_count"))


_RATES = """rates AS (SELECT count(*) AS case_count, CAST(1 AS DOUBLE) AS schema_pass_rate, round(avg(CASE WHEN category = 'grounded' THEN 1.0 ELSE 0.0 END), 4) AS groundedness_rate, round(avg(CASE WHEN winner_ok THEN 1.0 ELSE 0.0 END), 4) AS winner_consistency_rate,
    round(avg(CASE WHEN rejections_ok THEN 1.0 ELSE 0.0 END), 4) AS rejection_accuracy_rate, round(avg(CASE WHEN readable THEN 1.0 ELSE 0.0 END), 4) AS readability_pass_rate, round(avg(CASE WHEN category = 'grounded' THEN 0.0 ELSE 1.0 END), 4) AS hallucination_rate,
    round(avg(CASE WHEN category = 'grounded' AND rejections_ok AND readable THEN 1.0 ELSE 0.0 END), 4) AS overall_pass_rate FROM graded)"""


@query("text_suite_rates", with_(*_GRADED, _RATES) + "SELECT * FROM rates")
def _(spark, sf):
    return textcheck.suite_rates(judged_documents(spark, sf))


@query("text_gate_violations", with_(*_GRADED, _RATES) + " UNION ALL ".join(
    f"SELECT '{n}' AS rate, {n} AS actual, CAST({b} AS DOUBLE) AS gate FROM rates WHERE {n} {'<' if k == 'min' else '>'} {b}" for n, (b, k) in textcheck.GATES.items()))
def _(spark, sf):
    return textcheck.gate_violations(textcheck.suite_rates(judged_documents(spark, sf))).select("rate", "actual", "gate")


@query("text_basic_report", with_(*_GRADED) + """SELECT count(*) AS case_count, round(avg(CASE WHEN ungrounded = 0 THEN 1.0 ELSE 0.0 END), 4) AS groundedness_rate, round(1 - avg(CASE WHEN ungrounded = 0 THEN 1.0 ELSE 0.0 END), 4) AS hallucination_rate,
    round(avg(CASE WHEN word_count <= 70 THEN 1.0 ELSE 0.0 END), 4) AS length_compliance_rate, round(avg(word_count), 1) AS average_word_count FROM graded""")
def _(spark, sf):
    return textcheck.basic_report(judged_documents(spark, sf))


# -- scrubbing -------------------------------------------------------------------------------------

_SCRUB = f"""z0 AS (SELECT doc_id, text AS a FROM documents), z1 AS (SELECT *, regexp_replace(a, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g') AS b FROM z0),
z2 AS (SELECT *, regexp_replace(b, '(?i)ignore\\s+(all\\s+)?(previous|prior|above)\\s+instructions?|disregard\\s+(all\\s+)?(previous|prior|above)\\s+instructions?|you\\s+are\\s+now\\b|new\\s+instructions?\\s*:|system\\s*prompt\\s*:|\\bact\\s+as\\b|\\breveal\\s+(the\\s+)?(system\\s+)?prompt\\b|\\bprint\\s+(the\\s+)?(system\\s+)?prompt\\b', '[redacted]', 'g') AS c FROM z1),
z3 AS (SELECT *, regexp_replace(c, '(?im)[#`]{{2,}}|^\\s*(system|assistant|user)\\s*:', ' ', 'g') AS d FROM z2), z4 AS (SELECT *, {STRIP(f"regexp_replace(d, '{WS}+', ' ', 'g')")} AS e FROM z3),
z5 AS (SELECT *, CASE WHEN length(e) > 120 THEN regexp_replace(substring(e, 1, 120), '{WS}+$', '') || '…' ELSE e END AS f FROM z4)"""


def scrubbed(spark, sf) -> DataFrame:
    return textcheck.scrub(widen(table(spark, sf, "documents").select("doc_id", "text")), "text")


@query("text_scrub", with_(_SCRUB) + "SELECT doc_id, f AS scrubbed FROM z5")
def _(spark, sf):
    return scrubbed(spark, sf).select("doc_id", "scrubbed")


@query("text_scrub_report", with_(_SCRUB) + "SELECT count(*) FILTER (a <> b) AS control, count(*) FILTER (b <> c) AS instruction, count(*) FILTER (c <> d) AS role_marker, count(*) FILTER (d <> e) AS whitespace, count(*) FILTER (e <> f) AS length FROM z5")
def _(spark, sf):
    return textcheck.scrub_report(scrubbed(spark, sf))


def _redact(x):
    for pattern, put in textcheck.REDACTIONS:
        if pattern.startswith("(?<!"):  # the SQL engine has no look-behind: keep the character before the path instead
            pattern, put = r"(^|[^\w/])" + pattern.split(")", 1)[1], r"\1" + put
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return STRIP(x)


for _source, _key in (("documents", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id")):
    @query(f"text_redact_{_source}", f"SELECT {_key}, md5({_redact('html' if _source == 'pages' else 'text')}) AS redacted FROM {_source}")
    def _(spark, sf, source=_source, key=_key):
        column = "html" if source == "pages" else "text"
        return widen(table(spark, sf, source).select(key, column)).select(key, F.md5(textcheck.redact(F.col(column)).cast("binary")).alias("redacted"))


_ERRORS = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in textcheck.ERROR_CATEGORIES) + " ELSE 'other' END"


@query("text_error_categories", f"SELECT {_ERRORS} AS category, count(*) AS texts FROM documents GROUP BY 1")
def _(spark, sf):
    return widen(table(spark, sf, "documents").select("text")).groupBy(textcheck.error_category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("texts"))


@query("text_word_cap", f"""SELECT conv_id, turn, CASE WHEN len(w) <= 25 THEN array_to_string(w, ' ') ELSE regexp_replace(array_to_string(w[1:25], ' '), '[,;:]+$', '') || '…' END AS capped FROM (SELECT conv_id, turn, {WORDS('text')} AS w FROM conversations)""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", cap_words(F.col("text"), 25).alias("capped"))
