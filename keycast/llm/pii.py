"""Personal data: fixed base patterns, and identifiers found by the contexts that the base ones stand in.

The base finds whole, valid identifiers. They are the seeds of a bootstrap over
the corpus: the two words before a seed are a lexical pattern, and a pattern is
the more trusted the more of the identifier-shaped strings behind it are known
to be of its kind; a string is the more trusted the more trusted patterns it
stands in. Patterns and strings score each other for a few rounds over the graph
of their meetings, and strings that pass the bar are identifiers too, though
the base rejects them (a wrong check digit, a part missing). Everything is a
DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast.llm.shared import free, kept, stored

# Kinds in the order that spans with one start are listed in. The patterns find what the plain ones of the
# contract find, written so that no input makes them go back over what they have read.
KINDS = ("email", "ip", "card", "phone")
_FRESH = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Groups of digits joined by single separators, as numbers are written in the base patterns, from the start of a token.
_RUN = r"(?<!\S)[^\s\p{L}0-9@+(]*+[+(]{0,2}[0-9]++(?:(?:[\x20.-]?\(|\)[\x20.-]?|[\x20.-])[0-9]++(?![\p{L}@_]))++"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
_EMPTY_SPANS = f"cast(array() as {_SPAN})"


@dataclass(frozen=True)
class Bootstrap:
    """How much evidence a discovered identifier needs."""

    rounds: int = 3
    least_values: int = 3  # distinct strings behind a pattern that is trusted at all
    bar: float = 0.8  # score of an accepted string
    before: int = 64  # characters of the text before a string that are looked at


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _keeper(kind: str):
    return lambda span: _valid(kind, span["value"])


def _places(matches: Column, between: Column, kind: Column) -> Column:
    """Spans of all matches, from the matches and the text between them: positions are running lengths."""
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(_EMPTY_SPANS).alias("spans"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), kind.alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, start, step, lambda held: held["spans"])


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add `base`: all base spans of a text, by start and kind. `text` must not be null."""
    rare = {"email": F.instr(F.col(text), "@") > 0, "phone": F.instr(F.col(text), "+") > 0}
    numbers = F.col(text).rlike("[0-9]")
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        worth = rare.get(kind, numbers)
        rows = rows.withColumn(f"_m_{kind}", F.when(worth, F.regexp_extract_all(text, pattern, 0)))
        rows = rows.withColumn(f"_b_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)))
    parts = []
    for number, kind in enumerate(KINDS):
        places = _places(F.col(f"_m_{kind}"), F.col(f"_b_{kind}"), F.lit(number))
        good = F.filter(places, _keeper(kind))
        parts.append(F.when(F.size(f"_m_{kind}") > 0, good).otherwise(F.expr(_EMPTY_SPANS)))
    rows = rows.withColumn("base", F.sort_array(F.concat(*parts)))
    return rows.drop(*(f"_{x}_{kind}" for kind in KINDS for x in "mb"))


def _shape(value: Column) -> Column:
    """The kind a string could be by its looks, or null; an address may lack parts, a number may fail its check."""
    digits = F.length(_digits(value))
    return (
        F.when(value.rlike(r"^[^@]+@[^@]+$"), 0)
        .when(value.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}$") & (digits >= 4), 1)
        .when(value.rlike(r"^[0-9 -]+$") & digits.between(12, 22), 2)
        .when(value.rlike(r"^[+(]{0,2}[0-9\x20().+-]+$") & digits.between(7, 15), 3)
        .cast("int")
    )


def strings(rows: DataFrame, settings: Bootstrap, text: str = "text") -> DataFrame:
    """Add `strings`: identifier-shaped strings that do not touch a base span, and `seeds`: (context, kind, value) of the base ones.

    A string is a token without white space, or a run of digit groups over
    single separators. Where a whole run looks like no kind, its longest start
    of whole groups that does stands for it.
    """
    numbers = F.col(text).rlike("[0-9@]")
    for name, pattern in (("token", _TOKEN), ("run", _RUN)):
        rows = rows.withColumn(f"_m_{name}", F.when(numbers, F.regexp_extract_all(text, F.lit(pattern), 0)))
        rows = rows.withColumn(f"_b_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(text, F.lit(pattern), -1)))

    def before(part: Column) -> Column:
        """The last two words, or one, as far back as a token with a digit."""
        words = F.regexp_extract(F.lower(F.right(part, F.lit(settings.before))), r"(?:(?<!\S)[^\s0-9@]+\s+)?(?<!\S)[^\s0-9@]+\s*$", 0)
        return F.trim(F.regexp_replace(words, r"\s+", " "))

    def string(start: Column, value: Column, part: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before(part).alias("context"))

    def lead(value: Column) -> Column:
        return F.length(F.regexp_extract(value, r"^[^\p{L}0-9@+(]*+", 0))

    def trimmed(s: Column, i: Column) -> Column:
        value = F.regexp_replace(F.substring(s["value"], lead(s["value"]) + 1, F.length(s["value"])), r"[^\p{L}0-9]{1,8}$", "")
        return string(s["start"] + lead(s["value"]), value, F.col("_b_token")[i])

    def shaped_start(s: Column, i: Column) -> Column:
        run = F.substring(s["value"], lead(s["value"]) + 1, F.length(s["value"]))
        starts = [run, *(F.regexp_extract(run, rf"^(?:[^0-9]{{0,3}}[0-9]){{7,{most}}}(?![0-9])", 0) for most in (22, 15))]
        value = F.coalesce(*(F.when(_shape(v).isNotNull(), v) for v in starts), run)
        return string(s["start"] + lead(s["value"]), value, F.col("_b_run")[i])

    places = lambda name: _places(F.col(f"_m_{name}"), F.col(f"_b_{name}"), F.lit(-1))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string,context:string>>)")
    tokens = F.when(F.size("_m_token") > 0, F.transform(places("token"), trimmed)).otherwise(none)
    runs = F.when(F.size("_m_run") > 0, F.transform(places("run"), shaped_start)).otherwise(none)
    rows = rows.withColumn("_s", F.array_distinct(F.concat(tokens, runs)))
    rows = rows.withColumn("_s", F.filter("_s", lambda s: F.length(s["context"]) > 0))
    touches = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    free = F.filter("_s", lambda s: ~touches(s))
    shaped = F.filter(
        F.transform(free, lambda s: F.struct(s["context"].alias("context"), _shape(s["value"]).alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))),
        lambda s: s["kind"].isNotNull(),
    )
    # A seed gives its context to its kind: the string that starts where the base span does.
    seeds = F.filter(
        F.transform("_s", lambda s: F.struct(
            s["context"].alias("context"),
            F.get(F.filter("base", lambda b: b["start"] == s["start"]), F.lit(0)).alias("span"),
        )),
        lambda s: s["span"].isNotNull(),
    )
    seeds = F.transform(seeds, lambda s: F.struct(s["context"].alias("context"), s["span"]["kind"].alias("kind"), s["span"]["value"].alias("value")))
    return rows.withColumn("strings", shaped).withColumn("seeds", seeds).drop("_s", *(f"_{x}_{name}" for name in ("token", "run") for x in "mb"))


def discover(found: DataFrame, settings: Bootstrap) -> DataFrame:
    """kind and value of the strings that score at least the bar.

    `found` has `strings` and `seeds`. The graph has an edge per distinct
    (pattern, string), whatever the number of their meetings.
    """
    known = found.select(F.explode("seeds").alias("s")).select("s.context", "s.kind", "s.value").withColumn("seed", F.lit(1.0))
    other = found.select(F.explode("strings").alias("s")).select("s.context", "s.kind", "s.value").withColumn("seed", F.lit(0.0))
    edges = known.union(other).groupBy("context", "kind", "value").agg(F.max("seed").alias("score"))
    edges = kept(edges)
    if edges.where("score = 0").isEmpty():
        return edges.select("kind", "value").limit(0)
    for _ in range(settings.rounds):
        patterns = edges.groupBy("context", "kind").agg(F.avg("score").alias("trust"), F.count(F.lit(1)).alias("values"))
        patterns = patterns.where(F.col("values") >= settings.least_values)
        scored = edges.join(patterns, ["context", "kind"], "left")
        doubt = F.sum(F.log(1 - F.least(F.coalesce("trust", F.lit(0.0)), F.lit(0.999999))))
        fresh = scored.groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("fresh"), F.max(F.col("score") == 1.0).alias("seed"))
        again = edges.join(fresh, ["kind", "value"])
        edges = kept(again.select("context", "kind", "value", F.when(F.col("seed"), 1.0).otherwise(F.least("fresh", F.lit(0.999999))).alias("score")))
    return edges.where((F.col("score") >= settings.bar) & (F.col("score") < 1)).select("kind", "value").distinct()


def personal_data(docs: DataFrame, settings: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, `base` (spans of the base) and `spans` (base and discovered ones, by start and kind).

    Starts and ends count characters, end exclusive. A null text is empty and
    has no spans; null ids and repeated rows stay as they are; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    found = strings(base_spans(rows), settings).drop("text")
    return _with_discovered(stored(found, "personal"), settings)


def _with_discovered(found: DataFrame, settings: Bootstrap) -> DataFrame:
    """Join discovered spans to their rows, by id and hash of the text."""
    accepted = discover(found, settings)
    asked = found.where(F.size("strings") > 0).select(F.struct("doc_id", "text_hash").alias("key"), F.explode("strings").alias("s"))
    more = asked.join(accepted, (F.col("s.kind") == F.col("kind")) & (F.col("s.value") == F.col("value"))).groupBy("key").agg(
        F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))).alias("more")
    )
    more = more.withColumn("more", _outermost(F.col("more")))
    joined = found.join(more, F.struct("doc_id", "text_hash") == F.col("key"), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.expr(_EMPTY_SPANS))))
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"))


def _outermost(spans: Column) -> Column:
    """The spans without those that lie within another one: a group of digits may be known by itself."""
    longest_first = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.expr(_EMPTY_SPANS).alias("spans"))

    def step(held: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end"), s["value"].alias("value"))
        spans = F.when(-s["back"] <= held["at"], held["spans"]).otherwise(F.concat(held["spans"], F.array(span)))
        return F.struct(F.greatest(held["at"], -s["back"]).alias("at"), spans.alias("spans"))

    return F.aggregate(longest_first, start, step, lambda held: held["spans"])


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """Counts of base spans per kind, the digest of the base, all spans, and how many of them were discovered."""
    found = personal_data(docs, settings)
    count = lambda number: F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")
    return found.select(
        "doc_id", *(count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"),
    )


def masked(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """`docs` with each span of its text replaced by its kind in angle brackets, and n_chars set anew.

    All other columns and rows stay; overlapping spans become one mark, of the first of them; null texts stay null.
    """
    key_name, spans_name, text_name = free(docs, "_key", "_spans", "_text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = stored(strings(base_spans(rows.withColumn("text_hash", F.xxhash64("text"))), settings).drop("text"), "personal")
    spans = _with_discovered(found, settings).where(F.size("spans") > 0)
    spans = spans.select(F.struct("doc_id", "text_hash").alias(key_name), F.col("spans").alias(spans_name)).dropDuplicates([key_name])
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    joined = docs.join(spans, key == F.col(key_name), "left")
    names = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        inside = s["start"] < held["at"]
        return F.struct(
            F.greatest(held["at"], s["end"]).alias("at"),
            F.when(inside, held["out"]).otherwise(F.concat(held["out"], gap, names[s["kind"]])).alias("out"),
        )

    rest = lambda held: F.concat(held["out"], F.substring(F.col("text"), (held["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col(spans_name).isNotNull(), F.aggregate(spans_name, start, step, rest)).otherwise(F.col("text"))
    out = joined.withColumn(text_name, text)
    columns = {"text": F.col(text_name), "n_chars": F.coalesce(F.length(text_name), F.lit(0)).cast("long")}
    return out.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
