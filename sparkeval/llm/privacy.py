"""Personal data by bootstrapped contextual extraction.

Fixed patterns find the seeds: e-mail and IP addresses, card and phone numbers. Their places come from the pieces between matches, by a
running sum. The one to three words in front of a seed, as in "mail:", "id =" or "call me at", and the two or three words behind it, as in
"is my number", become lexical patterns; every place where such words stand beside a value is an edge between a pattern and an instance. A
single word is a pattern only with : or = between it and the value: by itself it may stand before anything. Rounds of joins and
grouped sums score patterns by the share of their values that are known and instances by the patterns that point to them, until no
pattern is added; patterns that score high give the spans of identifiers that the seed patterns miss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import drop_staged, read, stage

KINDS = ("email", "ip", "card", "phone")
LABEL = len(KINDS)
BEHIND = LABEL + 1
# Possessive forms of the seed patterns: a run of characters is tried once, from its start or from the end of the last match.
SEEDS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
HINTS = ("@", r"[0-9]\.[0-9]", r"[0-9]", r"\+[0-9]")
#: What a value may look like: an address (its parts as long as mail allows), a network address, seven digits and more with what
#: people write between them. A space goes on with a number only before two digits.
SHAPES = (
    r"[^\s@\"'<>(),;:\[\]]{1,64}+(?:@|\[at\]|\(at\))[^\s@\"'<>(),;\[\]]{0,254}[^\s@\"'<>(),;:.!?\[\]]",
    r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f.]*[0-9A-Fa-f])?",
    r"[0-9]{1,3}(?:[.-][0-9]{1,3}){3}(?![0-9])",
    r"\+?\(?[0-9](?:(?:[()._/-]|\x20(?=\(?[0-9]{2})){0,3}[0-9]){6,29}+",
)
#: Up to three words and what divides them from the value; group 1 is the value, which is not consumed. After : or = any four
#: characters count as a value (group 1 is empty then), elsewhere only one of the shapes.
LABELLED = (
    r"(?<!\p{L})(?:\p{L}{1,30}+\s{1,3}+){0,2}\p{L}{1,30}+(?:\s?[:=.#]\s{0,3}|\s{1,3})(?:[\"'<]|\((?=\p{L}))?"
    r"(?=(" + "|".join(SHAPES) + r")|(?<=[:=]\s{0,3}[\"']?)[^\s\"']{4})"
)
#: A value, and behind it two or three words (group 2).
FOLLOWED = r"(?<![^\s\"'<(\[:=])(" + "|".join(SHAPES) + r")(?=[\"'>)\]]?[\s,;]{1,3}(\p{L}{1,30}\s{1,3}\p{L}{1,30}(?:\s{1,3}\p{L}{1,30})?)(?!\p{L}))"
#: The part of a value that is an identifier, by kind; the longest that a number's digits allow.
LOOKS = (
    r"^[^@\s]+(?:@|[\[(]at[\])])[^@\s]+$",
    r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f.]*$|^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}$",
    r"^(?:[0-9][\x20._/-]?){7,18}[0-9](?![0-9])",
    r"^\+?\(?[0-9](?:[\x20()._/-]{0,3}[0-9]){6,14}(?![0-9])",
)
LEAST_SUPPORT, LEAST_SHARE, LEAST_SCORE = 3, 0.6, 0.6


FOUND = "array<struct<kind:int,at:int,lead:int,match:string,value:string,words:string>>"


def _pieces(text: Column, pattern: str, hint: str, kind: int) -> Column:
    """Matches of a pattern with their number, the length of what lies before each, since the match before, and a context's value and words."""
    group = lambda n, used: F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) if used else F.array().cast("array<string>")
    parts = F.arrays_zip(
        group(0, True).alias("match"), F.transform(F.split(text, pattern, -1), F.char_length).alias("lead"),
        group(1, kind >= LABEL).alias("value"), group(2, kind == BEHIND).alias("words"),
    )
    each = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["lead"].alias("lead"), x["match"].alias("match"), x["value"].alias("value"), x["words"].alias("words")))
    found = F.filter(each, lambda x: x["match"].isNotNull())
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(FOUND))


def _labels(match: Column, words: Column) -> Column:
    """The last word, the last two and all three before a value, in lower case, with : where one of : and = divides them from the value, alone
    only then; or the first two and all three behind it, after >."""
    before = F.regexp_extract_all(F.lower(match), F.lit(r"\p{L}+"), F.lit(0))
    marked = match.rlike("[:=]")
    left = F.transform(F.sequence(F.lit(1), F.size(before)), lambda n: F.concat(F.array_join(F.slice(before, -n, n), " "), F.when(marked, ":").otherwise("")))
    left = F.filter(left, lambda x: marked | x.contains(" "))
    behind = F.regexp_extract_all(F.lower(words), F.lit(r"\p{L}+"), F.lit(0))
    right = F.transform(F.sequence(F.lit(2), F.greatest(F.size(behind), F.lit(2))), lambda n: F.concat(F.lit("> "), F.array_join(F.slice(behind, 1, n), " ")))
    return F.when(words.isNull(), left).otherwise(F.array_distinct(right))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.char_length(digits)),
        lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(back, i, F.lit(1)).cast("int"))
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    card = F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == 2, card)
        .when(kind == 3, F.char_length(digits).between(9, 15))
        .otherwise(True)
    )


def _identifier(kind: Column, value: Column) -> Column:
    """The part of a value that is an identifier of the kind; empty if it is none."""
    part = lambda k: F.regexp_extract(value, LOOKS[k], 0)
    return reduce(lambda a, k: a.when(kind == k, part(k)), range(1, len(KINDS)), F.when(kind == 0, part(0))).otherwise("")


def discover(edges: DataFrame) -> DataFrame:
    """edges (label, value, seed: its kind or null): the (label, kind) patterns to be trusted, with share and support.

    A pattern's share is the part of all its occurrences whose value is known for the kind; known are the seeds, and
    instances whose patterns together (noisy or) reach LEAST_SCORE. Trusted patterns only grow; rounds end when none is added. Grouped by label and value: a frequent label costs one row a task.
    """
    edges = stage(edges.groupBy("label", "value", "seed").agg(F.count("*").alias("n")), "privacy_edges")
    totals = edges.groupBy("label").agg(F.sum("n").alias("total"))
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    known, patterns = seeds, None
    while True:
        hits = edges.where("value != ''").join(known, "value").groupBy("label", "kind").agg(F.sum("n").alias("hits"), F.count_distinct("value").alias("support"))
        scored = hits.join(totals, "label").withColumn("share", F.least(F.lit(1.0), F.col("hits") / F.col("total")))
        trusted = stage(scored.where((F.col("support") >= LEAST_SUPPORT) & (F.col("share") >= LEAST_SHARE)).select("label", "kind", "share", "support"), "privacy_patterns")
        last, patterns = patterns, trusted
        n = trusted.count()
        if n == 0 or (last is not None and last.count() == n):
            break
        reached = edges.where("seed is null").join(trusted, "label").where(_identifier(F.col("kind"), F.col("value")) != "")
        reached = reached.groupBy("value", "kind", "label").agg(F.max("share").alias("share"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))
        found = reached.groupBy("value", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= LEAST_SCORE)
        known = seeds.unionByName(found.select("value", "kind")).distinct()
    drop_staged(edges)
    return patterns


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every row: an array, sorted, of (start, kind, end, base), in code points, end exclusive.

    Base spans come from the seed patterns, the others from trusted labels; these never overlap a base span. Null and empty
    texts have none. Repeated rows and null ids are rows of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_pieces(F.col("text"), p, h, k) for k, (p, h) in enumerate(zip(SEEDS, HINTS, strict=True))], _pieces(F.col("text"), LABELLED, r"[:=@0-9]|[\[(]at[\])]", LABEL), _pieces(F.col("text"), FOLLOWED, r"[@0-9]|[\[(]at[\])]", BEHIND))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = stage(rows.select("row", "id", found.alias("found")), "privacy_matches")
    each = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    inside = Window.partitionBy("row", "kind").orderBy("at")
    before = F.coalesce(F.sum(F.char_length("match")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (F.sum("lead").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + before).cast("long")
    each = each.withColumn("start", start).where(_valid(F.col("kind"), F.col("match")))
    each = stage(each.select("row", "kind", "start", (F.col("start") + F.char_length("match")).alias("end"), "match", "value", "words"), "privacy_spans")
    base = each.where(F.col("kind") < LABEL).select("row", "kind", "start", "end")

    at = F.when(F.col("kind") == LABEL, F.col("end")).otherwise(F.col("start"))
    labels = each.where(F.col("kind") >= LABEL).select("row", F.explode(_labels(F.col("match"), F.col("words"))).alias("label"), "value", at.alias("start"))
    seeds = each.where(F.col("kind") < LABEL).select("row", "start", F.col("kind").alias("seed"), "match")
    edges = labels.join(seeds, ["row", "start"], "left")
    own = F.when((F.col("value") == "") & F.col("seed").isNotNull(), F.col("match")).otherwise(F.col("value"))  # a seed of no shape
    edges = stage(edges.withColumn("value", own).drop("match"), "privacy_labels")
    trusted = discover(edges.select("label", F.lower("value").alias("value"), "seed"))
    new = edges.where("seed is null").join(trusted, "label").withColumn("value", _identifier(F.col("kind"), F.col("value"))).where("value != ''")
    new = new.select("row", "kind", "start", (F.col("start") + F.char_length("value")).alias("end"))
    taken = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    new = new.join(taken, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_anti")
    every = base.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)).distinct())
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return rows.select("row", "id").join(spans, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = find_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return out.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
