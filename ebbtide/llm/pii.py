"""Personal data by patterns and by bootstrapped contextual extraction; DataFrame operations only.

Base spans are what fixed patterns match and their checks accept. They are the seed entities of the bootstrapping:

1. Every base span is an instance as a whole. Outside of base spans, instances are runs of digit groups (joined by a blank,
   hyphen, bracket, point, comma or slash), colon-joined hexadecimal groups, and tokens with a digit or an at sign. What stands
   around an instance, up to the next one, makes its lexical patterns: the word before, the two words before, the word behind
   (small letters). Each blank-separated part of a run is an instance too, but counts for no pattern.
2. Pattern and instance form a graph. A pattern's score for a kind is the share of its distinct instances that are
   known to be of that kind, each by its own score (seeds have 1). It is reliable with ``MIN_SEEDS`` different known instances
   and a score of ``RELIABLE``.
3. An unseen instance's score is that of its best reliable pattern, and its rank is the score times its likeness to the
   kind's seeds (length, digits, points, separators, at sign, letters, plus sign; see ``likeness``: features shared by degree,
   no form is required). With a rank of ``ACCEPT`` it is known, and all is computed anew until no instance is added.
4. Known instances that no base span covers become further spans; of a run and its parts, whichever ranks higher. Base
   spans always stay.

Counts are of distinct instances, so copies of a document add nothing. All counts are aggregated before a shuffle, so a
pattern as common as "the" is one row per task; a text without digit or at sign is never searched. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.vectors import let
from ebbtide.llm.common import table
from ebbtide.llm.queries import register
from ebbtide.session import written

KINDS = ["email", "ip", "card", "phone"]
#: The patterns are those of the contract. Possessive repeats and the look-behinds change no match: the repeated classes
#: exclude what follows them. They keep long runs from being searched again from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that a kind's pattern can match holds this.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A digit group, which no letter or at sign follows, and runs of such groups; hexadecimal groups; other tokens up to a mark
#: that separates. Possessive loops, as they need no stack in long tables of numbers.
_GROUP = r"[0-9]++(?![\p{L}@_]|[._-][\p{L}@])"
_RUN = rf"(?<![\p{{L}}\p{{N}}@])\+?(?:\((?=[0-9]++\)[\x20-]?[0-9]))?{_GROUP}(?:(?:[.,/]|\)?[\x20-]?\(?|\x20-\x20){_GROUP})*+"
_HEX = r"(?<![\p{L}\p{N}:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){2,}+(?![\p{L}\p{N}])"
_ENDS = r"\x20\x09-\x0D:;,=\"'<>|()\[\]{}"
_TOKEN = rf"(?:\G|(?<![^{_ENDS}]))[^{_ENDS}0-9@]*+[0-9@][^{_ENDS}]*+"
INSTANCE = rf"{_HEX}|{_RUN}|{_TOKEN}"
_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
MIN_SEEDS, RELIABLE, ACCEPT = 5, 0.8, 0.45
#: Values summed in one run, see _running.
RUN = 256
SPAN = "array<struct<kind:int,start:int,end:int>>"


PLACES = "array<struct<start:int,end:int,match:string,before:string,behind:string>>"


def _sums(few: Column) -> Column:
    """Running sums of a short array; each step copies what it has so far."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

    return F.aggregate(few, start, step, lambda acc: acc["out"])


def _running(lengths: Column) -> Column:
    """Running sums in two levels, of runs of ``RUN`` values and of the runs' totals, so that long texts stay cheap."""

    def in_runs(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
        return let(F.transform(numbers, lambda c: _sums(F.slice(values, c * RUN + 1, RUN))), shifted)

    def shifted(runs: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), _sums(F.transform(runs, lambda r: F.element_at(r, -1))))
        moved = F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda r, o: F.transform(r, lambda x: x + o))
        return F.flatten(moved)

    return let(lengths, lambda values: F.when(F.size(values) > 0, in_runs(values)).otherwise(F.array().cast("array<int>")))


def _in_order(found: Column, gaps: Column) -> Column:
    """Matches and the gaps around them as (start, end, match, what stands before, what stands behind)."""
    # zipped, not looked up: a lambda would split the text anew for each match
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    steps = F.zip_with(steps, F.slice(gaps, 2, F.size(gaps)), lambda x, g: F.struct(x["match"].alias("match"), x["gap"].alias("gap"), g.alias("next")))

    def placed(kept: Column) -> Column:
        ends = _running(F.transform(kept, lambda x: F.length(x["gap"]) + F.length(x["match"])))

        def row(x: Column, end: Column) -> Column:
            begin = end - F.length(x["match"])
            return F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), x["gap"].alias("before"), x["next"].alias("behind"))

        return F.zip_with(kept, ends, row)

    return let(F.filter(steps, lambda x: x["match"].isNotNull()), placed)


def _placed(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` from left to right, see _in_order."""
    return _in_order(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _holds(kind: str, match: Column) -> Column:
    """The check of a kind; a match that fails is dropped."""
    if kind == "ip":
        return match.rlike(rf"\A(?:{_PART}\.){{3}}{_PART}\z")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed and then by start."""

    def of(number: int, kind: str) -> Column:
        kept = F.filter(_placed(text, PATTERNS[kind]), lambda x: _holds(kind, x["match"]))
        spans = F.transform(kept, lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        possible = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
        return F.when(possible, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.concat(*(of(i, k) for i, k in enumerate(KINDS)))


def _last_words(text: Column) -> Column:
    """Up to two last words in front of an instance, small letters only."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.right(text, F.lit(80))), r"[^\p{L}]+", " "), " "), lambda w: w != "")


def _clusters(spans: Column) -> Column:
    """Spans in order, those that overlap as one: (start, end)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        inside = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        return F.when((F.size(out) > 0) & (s["start"] < last["end"]), inside).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), step)


def _with_places(rows: DataFrame, text: Column) -> DataFrame:
    """Adds clusters of base spans, the base spans' texts (cut), and the pieces of text between the clusters: where each
    starts, the instances in it with up to 80 characters before and 60 behind, and the text at its own ends."""
    rows = rows.withColumn("clusters", _clusters(F.col("base")))
    rows = rows.withColumn("cut", F.transform("base", lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])))

    def piece(i: Column) -> Column:
        start = F.coalesce(F.get("clusters", i - 1)["end"], F.lit(0))
        end = F.coalesce(F.get("clusters", i)["start"], F.length(text))
        return F.struct(start.alias("start"), F.substring(text, start + 1, end - start).alias("text"))

    pieces = F.transform(F.sequence(F.lit(0), F.size("clusters")), piece)
    rows = rows.withColumn("pieces", F.when(text.rlike("[0-9@]"), pieces))

    def searched(p: Column) -> Column:
        found = F.regexp_extract_all(p["text"], F.lit(INSTANCE), F.lit(0))
        return F.struct(p["start"].alias("start"), found.alias("found"), F.split(p["text"], INSTANCE, -1).alias("gaps"))

    rows = rows.withColumn("pieces", F.transform("pieces", searched))

    def near(x: Column) -> Column:
        around = [F.right(x["before"], F.lit(80)).alias("before"), F.left(x["behind"], F.lit(60)).alias("behind")]
        return F.struct(x["start"].alias("start"), x["match"].alias("match"), *around)

    def placed(p: Column) -> Column:
        first, last = F.left(F.get(p["gaps"], 0), F.lit(60)), F.right(F.element_at(p["gaps"], -1), F.lit(80))
        found = F.transform(_in_order(p["found"], p["gaps"]), near)
        return F.struct(p["start"].alias("start"), found.alias("found"), first.alias("first"), last.alias("last"))

    return rows.withColumn("pieces", F.transform("pieces", placed))


def _trimmed(rows: DataFrame) -> DataFrame:
    """Matches without marks at their ends."""
    lead = F.length(F.regexp_extract("match", r"\A[^\p{L}\p{N}+(]*+", 0))
    name = F.regexp_extract("match", r"\A[^\p{L}\p{N}+(]*+(.*[\p{L}\p{N}])", 1)
    return rows.withColumn("start", F.col("start") + lead).withColumn("match", name).where("match != ''")


def instances(found: DataFrame) -> DataFrame:
    """Base spans and, outside of them, runs, their parts and tokens: row, run, whether whole, kind (null: not a base span), place,
    name, patterns."""
    pieces = found.select("row", F.explode("pieces").alias("p")).select("row", F.col("p.start").alias("from"), F.explode("p.found").alias("x"))
    whole = _trimmed(pieces.select("row", (F.col("from") + F.col("x.start")).alias("start"), "x.match", "x.before", "x.behind"))
    whole = whole.withColumn("run", F.col("start")).withColumn("whole", F.lit(True)).withColumn("kind", F.lit(None).cast("int"))
    # places by character and not by an aggregate, whose state is copied at each step: a table of numbers is one long run
    blanks = F.filter(F.transform(F.split("match", ""), lambda c, i: F.when(c == " ", i + 1)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), blanks)
    each = F.zip_with(F.split("match", " "), starts, lambda m, i: F.struct(m.alias("match"), i.alias("start"), (i + F.length(m)).alias("end")))
    parts = whole.where(F.contains("match", F.lit(" "))).withColumn("x", F.explode(each))
    # only the first part has words before it, and only the last has words behind
    parts = parts.withColumn("before", F.when(F.col("x.start") == 0, F.col("before")).otherwise(""))
    parts = parts.withColumn("behind", F.when(F.col("x.end") == F.length("match"), F.col("behind")).otherwise(""))
    parts = parts.withColumn("start", F.col("run") + F.col("x.start")).withColumn("match", F.col("x.match")).withColumn("whole", F.lit(False))
    seeds = found.withColumn("s", F.explode(F.arrays_zip("base", "cut")))
    at = F.size(F.filter("clusters", lambda c: c["start"] <= F.col("s.base.start")))
    seeds = seeds.select(
        "row", F.col("s.base.start").alias("start"), F.col("s.cut").alias("match"), F.get("pieces", at - 1)["last"].alias("before"),
        F.get("pieces", at)["first"].alias("behind"), F.col("s.base.start").alias("run"), F.lit(True).alias("whole"), F.col("s.base.kind").alias("kind"),
    )
    every = whole.unionByName(_trimmed(parts.drop("x"))).unionByName(seeds)
    every = every.withColumn("left", _last_words(F.col("before")))
    every = every.withColumn("right", F.regexp_extract(F.lower("behind"), r"\A[^\p{L}]*+(\p{L}++)", 1))
    left, none = F.col("left"), F.array().cast("array<string>")
    patterns = F.concat(
        F.when(F.size(left) >= 1, F.array(F.concat(F.lit("l:"), F.get(left, F.size(left) - 1)))).otherwise(none),
        F.when(F.size(left) >= 2, F.array(F.concat(F.lit("L:"), F.get(left, F.size(left) - 2), F.lit(" "), F.get(left, F.size(left) - 1)))).otherwise(none),
        F.when(F.col("right") != "", F.array(F.concat(F.lit("r:"), "right"))).otherwise(none),
    )
    end = F.col("start") + F.length("match")
    return every.select("row", "run", "whole", "kind", "start", end.alias("end"), F.lower("match").alias("name"), patterns.alias("patterns"))


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: base spans and where instances are, written once with a row number of its own (repeated ids stay apart)."""
    text = F.coalesce(F.col("whole"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("whole"), *(F.col(c).alias(f"kept_{c}") for c in keep or []))
    rows = rows.withColumn("base", F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast(SPAN)))
    kept = [f"kept_{c}" for c in keep or []]
    rows = _with_places(rows, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", *kept, "base", "clusters", "cut", "pieces")
    return written(rows, "personal")


#: Figures of an instance's form, from its name.
FEATURES = {
    "f_length": lambda n: F.length(n),
    "f_digits": lambda n: F.length(_digits(n)),
    "f_points": lambda n: F.length(F.regexp_replace(n, "[^.]", "")),
    "f_joints": lambda n: F.length(F.regexp_replace(n, r"[^\x20()-]", "")),
    "f_at": lambda n: F.contains(n, F.lit("@")).cast("int"),
    "f_letters": lambda n: n.rlike(r"\p{L}").cast("int"),
    "f_plus": lambda n: F.startswith(n, F.lit("+")).cast("int"),
}


def likeness(name: Column) -> Column:
    """How much a name is written like the seeds of a kind, whose means are columns of the names of FEATURES; from 0 to 1.

    Numbers are compared by their ratio, yes or no by the share of seeds that agree; the length counts by itself.
    """
    own = {k: f(name) for k, f in FEATURES.items()}

    def ratio(k: str) -> Column:
        return (F.least(own[k], F.col(k)) + 1) / (F.greatest(own[k], F.col(k)) + 1)

    same = [1 - F.abs(own[k] - F.col(k)) for k in ("f_at", "f_letters", "f_plus")]
    alike = [ratio(k) for k in ("f_digits", "f_points", "f_joints")] + same
    return F.sqrt(ratio("f_length")) * sum(alike[1:], alike[0]) / len(alike)


def discovered(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the instances that reliable patterns point to and no base span covers."""
    every = instances(found)
    edges = every.select("name", "kind", "whole", F.explode("patterns").alias("pattern"))
    graph = written(edges.groupBy("pattern", "name").agg(F.max("kind").alias("seed"), F.max("whole").alias("whole")), "graph")
    seeds = written(every.where("kind is not null").groupBy("name").agg(F.min("kind").alias("kind")), "seeds")
    # one row per kind
    means = F.broadcast(seeds.groupBy("kind").agg(*(F.avg(f(F.col("name"))).alias(k) for k, f in FEATURES.items())))
    own = [F.count(F.when(F.col("seed") == i, True)) for i in range(len(KINDS))]
    # a pattern of fewer instances can't have MIN_SEEDS known ones
    rated = graph.where("whole").groupBy("pattern").agg(F.count("*").alias("size"), F.array(*own).alias("seeds"))
    rated = written(rated.where(F.col("size") >= MIN_SEEDS), "rated")
    unseen = written(graph.where("seed is null").drop("seed").join(rated.select("pattern"), "pattern", "left_semi"), "unseen")
    counts = rated.select("pattern", F.posexplode("seeds").alias("kind", "known")).where("known > 0")
    counts = counts.withColumn("mass", F.col("known").cast("double"))
    known = seeds.select("name", "kind", F.lit(1.0).alias("score"), F.lit(1.0).alias("rank"))
    while True:
        sure = counts.where(F.col("known") >= MIN_SEEDS).join(rated.select("pattern", "size"), "pattern")
        sure = sure.select("pattern", "kind", (F.col("mass") / F.col("size")).alias("score")).where(F.col("score") >= RELIABLE)
        pointed = unseen.join(sure, "pattern").groupBy("name", "kind").agg(F.max("score").alias("score"))
        scored = pointed.join(means, "kind").select("name", "kind", "score", (F.col("score") * likeness(F.col("name"))).alias("rank"))
        scored = scored.where(F.col("rank") >= ACCEPT).groupBy("name")
        scored = scored.agg(F.max_by(F.struct("kind", "score", "rank"), F.struct("rank", -F.col("kind"))).alias("x"))
        new = written(scored.select("name", "x.*").join(known, "name", "left_anti"), "known")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        more = unseen.where("whole").join(new, "name").groupBy("pattern", "kind").agg(F.count("*").alias("known"), F.sum("score").alias("mass"))
        counts = counts.unionByName(more).groupBy("pattern", "kind").agg(F.sum("known").alias("known"), F.sum("mass").alias("mass"))
        counts = written(counts, "counts")
    spots = every.where("kind is null").select("row", "run", "whole", "start", "end", "name").join(known, "name")
    spots = spots.groupBy("row", "run").agg(F.collect_list(F.struct("whole", "rank", "kind", "start", "end")).alias("spots"))

    def chosen(every: Column) -> Column:
        top = F.array_max(F.transform(every, lambda x: F.struct(x["rank"].alias("rank"), x["whole"].alias("whole"))))
        return F.filter(every, lambda x: x["whole"] == top["whole"])

    return spots.select("row", F.explode(chosen(F.col("spots"))).alias("x")).select("row", "x.kind", "x.start", "x.end")


def with_spans(found: DataFrame) -> DataFrame:
    """``found`` with all spans: the base ones and, sorted among them, those discovered."""
    more = discovered(found).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    return found.join(more, "row", "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN))))
    )


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``; a null text counts as empty, an empty one has no spans."""
    return with_spans(found_in(docs, id_col, text_col)).select("doc_id", "base", "spans")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(
            F.greatest(acc["at"], -s["back"]).alias("at"), F.when(s["start"] >= acc["at"], clear).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; a row without any is returned as it was.

    What a replacement sets free (a number that ran into another) is looked for once more.
    """
    rows = with_spans(found_in(docs, id_col, text_col, docs.columns))
    old = F.col(f"kept_{text_col}")
    rows = rows.withColumn("once", F.when(F.size("spans") > 0, redacted(old, F.col("spans"))))
    rows = rows.withColumn("twice", F.when(F.col("once").isNotNull(), redacted(F.col("once"), base_spans(F.col("once")))))
    changed = F.coalesce("twice", old)
    return rows.select(*((changed if c == text_col else F.col(f"kept_{c}")).alias(c) for c in docs.columns))


@register("op6_pii_bootstrapping")
def op6_pii_bootstrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii_spans(table(spark, sf_dir, "documents"))

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
    )
