"""Secret scans with DataFrame functions only: fixed patterns, and runs of characters that look random to two Markov models.

Base spans, each kind leftmost and non-overlapping: `assign` (a keyword, a separator and a value of 8 characters or more), `access` (an access key of 16 or more) and `hex` (32 or more). Candidates for the kind `random` are whole runs of 20 or more key characters; a run counts if a first-order character model of random strings gives its different pairs of neighbours (SHORTEST / 2 or more) a clearly higher likelihood than one of ordinary identifiers (a higher one still where it has no digit), and no base span covers all of it.

Both models come from labelled samples (text, label: 1 random, 0 ordinary): pairs of characters are counted, smoothed by one half, and their logarithmic likelihood ratio is a table of fixed size, whatever the sample. samples() makes labelled rows by rule (SAMPLES of each label); any other labelled table can be given instead.

Positions count code points, ends are exclusive: text is split at the matches, and the lengths of gaps and matches add up.

Defined cases: a null text is empty and has no spans; a text of any length is searched whole, and its matches are added up in runs, so their number costs no square; spans that begin alike are ordered by kind and end; null and repeated doc_ids are kept row for row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Labelled samples of each label that samples() makes, mean log-likelihood ratio from which a run is random, shortest run.
SAMPLES, THRESHOLD, SHORTEST = 4096, 0.35, 20
#: The ratio that a run without digits must reach, which long words of prose do not.
LETTERS = 1.1
#: Matches whose spans are gathered together.
RUN = 256
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
WIDTH = len(ALPHABET)
KEYWORD = "((?i:password|passwd|secret|token|api_?key))"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
_RUN = "A-Za-z0-9+/_=-"
RANDOM = f"(?<![{_RUN}])[{_RUN}]{{{SHORTEST},}}+"
MASK = "[SECRET]"
# parts of ordinary identifiers
WORDS = "get set new old user account order item list map index count total value name type state status time date year month day start end first last next page size limit offset cache store table column row field key group file path folder config option flag level error message result response request handler service client server session event queue task worker thread process memory buffer stream reader writer parser token input output source target parent child node tree graph edge version update delete create insert select filter sort merge split join test example default local global public private static internal external".split()


def samples(spark: SparkSession, each: int = SAMPLES) -> DataFrame:
    """(text, label): digests in base 64, hexadecimal and upper-case letters and digits; identifiers of two to five words in three styles with a number."""
    i = spark.range(each)
    digest = F.sha2(F.col("id").cast("string"), 256)
    strings = F.element_at(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.translate(F.base64(F.unhex(digest)), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.translate(F.base64(F.unhex(digest)), "+/=", "-_")), (F.col("id") % 4 + 1).cast("int"))
    words = F.array(*map(F.lit, WORDS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    picked = F.slice(F.array(*[word(k) for k in range(5)]), 1, (F.lit(2) + F.col("id") % 4).cast("int"))
    number = (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string")
    camel = F.aggregate(picked, F.lit(""), lambda a, w: F.concat(a, F.initcap(w)))
    styles = F.array(F.concat_ws("_", picked), camel, F.concat_ws("-", picked), F.concat_ws("_", F.concat_ws("_", picked), number), F.concat(camel, number), F.concat_ws("/", F.concat_ws("/", picked), number), F.upper(F.concat_ws("_", picked)))
    names = F.element_at(styles, (F.col("id") % 7 + 1).cast("int"))
    return i.select(strings.alias("text"), F.lit(1).alias("label")).unionByName(i.select(names.alias("text"), F.lit(0).alias("label")))


def _pairs(chars: Column) -> Column:
    """The table index (from 0) of each pair of neighbours; other characters count as the last of the alphabet."""
    code = F.transform(chars, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(WIDTH - 1))
    return F.zip_with(F.slice(code, F.lit(1), F.greatest(F.size(code) - 1, F.lit(0))), F.slice(code, F.lit(2), F.greatest(F.size(code) - 1, F.lit(0))), lambda a, b: a * WIDTH + b)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio, random over ordinary, of each pair of characters: WIDTH * WIDTH numbers. Only these counts reach the driver."""
    counted = labelled.where("text IS NOT NULL AND label IS NOT NULL").select("label", F.explode(_pairs(F.split("text", ""))).alias("pair")).groupBy("label", "pair").count()
    counts = {0: [0.5] * WIDTH**2, 1: [0.5] * WIDTH**2}
    for label, pair, n in counted.collect():  # at most 2 * WIDTH * WIDTH rows
        counts[int(label)][pair] += n
    rows = {k: [sum(v[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)] for k, v in counts.items()}
    return [math.log(counts[1][p] / rows[1][p // WIDTH]) - math.log(counts[0][p] / rows[0][p // WIDTH]) for p in range(WIDTH**2)]


def _spans(text: Column, pattern: str, kind: str, rank: int, ok=None, group: int = 0) -> Column:
    """Spans of a pattern's matches; ok tells from a match's text (or that of a group) whether it stays."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), judged.alias("j"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,keep:boolean>>")

    def add(s, p):
        start = s["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        keep = ok(p["j"]) if ok else F.lit(True)
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), keep.alias("keep")))).alias("out"))

    # matches are added up in runs of RUN: arrays that grow one by one would cost the square of the matches
    run = lambda s, p: F.struct(F.aggregate(p, F.struct(s["last"]["at"].alias("at"), none.alias("out")), add).alias("last"), F.concat(s["runs"], F.array(s["last"]["out"])).alias("runs"))
    state = F.struct(F.struct(F.lit(0).alias("at"), none.alias("out")).alias("last"), F.array().cast("array<array<struct<start:int,rank:int,end:int,kind:string,keep:boolean>>>").alias("runs"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(parts, k + 1, F.lit(RUN)))
    found = F.aggregate(runs, state, run, lambda s: F.filter(F.concat(F.flatten(s["runs"]), s["last"]["out"]), lambda x: x["keep"]))
    # most texts have no match: they are looked through once
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, *more: str) -> DataFrame:
    """docs(doc_id, text and the columns `more`) with `base` and `found`, arrays of (start, rank, end, kind) in order; found has the base spans and those of the models."""
    table_ = F.array(*[F.lit(round(x, 6)) for x in ratios])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def random(run: Column) -> Column:
        # each pair counts once: a run of few different pairs is a rule or a filler, however unlikely they are
        pairs = F.array_distinct(_pairs(F.split(run, "")))
        ratio = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(table_, p + 1)) / F.size(pairs)
        return (F.size(pairs) >= SHORTEST // 2) & (ratio >= F.when(run.rlike("[0-9]"), threshold).otherwise(max(threshold, LETTERS)))

    kinds = F.concat(_spans(F.col("_text"), ASSIGN, "assign", 0, lambda v: F.length(v) >= 8, 2), _spans(F.col("_text"), ACCESS, "access", 1, lambda v: F.length(v) >= 16), _spans(F.col("_text"), HEX, "hex", 2))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), *more)
    out = out.withColumn("base", F.array_sort(kinds))
    # a run that goes beyond the base spans within it is a span of its own
    added = F.filter(_spans(F.col("_text"), RANDOM, "random", 3, random), lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return out.withColumn("found", F.array_sort(F.concat("base", added))).withColumnRenamed("_text", "text")


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with every found span of `text`, overlapping ones as one, replaced by MASK; other columns stay, but n_chars, where there is one, follows a changed text."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = scan(rows, ratios, threshold, "row")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s, p):
        piece = F.when(p["start"] >= s["at"], F.concat(F.substring(F.col("text"), s["at"] + 1, p["start"] - s["at"]), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    masked = F.aggregate("found", state, add, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.lit(2**31 - 1))))
    hit = F.size("found") > 0
    changed = found.select("row", hit.alias("hit"), F.when(hit, masked).otherwise(F.col("row.text")).alias("masked"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out["text"] = F.col("masked")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("hit"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return changed.select(*[v.alias(k) for k, v in out.items()])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(samples(spark)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
