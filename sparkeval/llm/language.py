"""Language identification by Bayesian evidence fusion.

The text gives likelihoods: hashed byte trigrams under one model per language, trained on a bounded sample of labelled documents,
and under a flat model for what is no language ("und"). The declared markup language and the address suffix are likelihoods too, and
the host gives the prior, smoothed towards its domain's and that towards the global one. Their tables are grouped sums of the texts'
own posteriors over all rows; a row's own share is taken out before the table judges it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import read, small, stage, trimmed
from sparkeval.llm.html_text import main_text

GRAMS = 1 << 16
SAMPLE_ROWS = 20_000  # labelled documents that the trigram models are trained on, whole texts, in equal parts for each label
LEAST_ROWS = 500  # but so many of a label at least, where it has them
MOST_LANGUAGES = 512  # models that fit the driver; ISO 639-1 has 184 codes
UNKNOWN = "und"
EVIDENCE = 300  # trigrams that a text counts as at most: they are not independent
SMOOTHING = 0.5
PRIOR_ROWS = 10.0  # rows that the wider level counts as
UNKNOWN_PRIOR = 1e-4


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased words; digits and ASCII punctuation count as spaces."""
    b = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 16) & (GRAMS - 1)


FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in bytes(range(256)).lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            mine = counts.setdefault(lang, np.zeros(GRAMS, np.int64))
            mine += np.bincount(trigrams((text.as_py() or "").lower().encode()), minlength=GRAMS)
    for lang, mine in counts.items():
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], ["lang", "gram", "n"])


def _language(lang_col: str) -> Column:
    """The label without its region, in lower case."""
    return F.lower(F.trim(F.split(F.col(lang_col).cast("string"), "[-_]")[0]))


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from about `rows` documents picked by the hash of their id, the same number of each label.

    A label with fewer documents than its part gives all, at every size of the table. The model that comes to the driver has at
    most MOST_LANGUAGES times GRAMS numbers.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    draw = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    known = known.select(_language(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    labels = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "language_labels")
    n = labels.count()
    part = max(rows / max(n, 1), LEAST_ROWS)
    shares = small(labels.select("lang", (F.lit(part) / F.col("n")).alias("share")), n)
    picked = known.join(shares, "lang").where(F.col("draw") < F.col("share")).select("lang", "text")
    counts = picked.mapInArrow(trimmed(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language_grams")
    kept = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    table, at = np.zeros((len(kept), GRAMS)), {lang: i for i, lang in enumerate(kept)}
    for r in counts.where(F.col("lang").isin(kept)).toLocalIterator():
        table[at[r["lang"]], r["gram"]] = r["n"]
    table = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * GRAMS))
    return kept, np.vstack([table, np.full(GRAMS, -np.log(GRAMS))]).astype(np.float32)


def _likelihoods(model: np.ndarray, from_html: bool, inside: str | None, evidence: int):
    """Tempered log-likelihoods of each text, and its posterior from the text alone; the text lies in field `inside` of the row if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.T)
        flat = np.zeros(table.shape[1])
        flat[-1] = np.log(UNKNOWN_PRIOR)
        for batch in batches:
            texts = pa.compute.struct_field(batch.column("row"), inside) if inside else batch.column("text")
            logs, soft, n = [], [], []
            for value in texts:
                text = value.as_py() or ""
                grams = trigrams((main_text(text) if from_html else text).lower().encode())
                log = table[grams].mean(axis=0, dtype=np.float64) * min(len(grams), evidence) if len(grams) else np.zeros(len(flat))
                power = np.exp(log + flat - (log + flat).max())
                logs.append(log)
                soft.append(power / power.sum() if len(grams) else np.zeros(len(flat)))
                n.append(len(grams))
            others = [x for x in batch.schema.names if x != "text"]
            ends = pa.array(np.arange(len(n) + 1) * len(flat), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0))) for x in (logs, soft)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in others], *lists, pa.array(n, pa.int64())], [*others, "loglik", "soft", "grams"])

    return run


LEVELS = ("domain_sums", "host_sums", "declared_sums", "suffix_sums")


def _fuse(names: list[str], total: np.ndarray, n_declared: int, n_suffix: int):
    """Posteriors from the texts' likelihoods, the hosts' priors and the tables of declarations and suffixes."""
    k = len(names)

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.full((len(column), k), np.nan)
        out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy().reshape(-1, k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            soft, logs = matrix(batch.column("soft")), matrix(batch.column("loglik"))
            sums = {x: np.maximum(matrix(batch.column(x)) - soft, 0.0) for x in LEVELS}  # without the row's own share
            every = np.maximum(total - soft, 0.0)
            prior = (every + 1.0 / k) / (every.sum(axis=1, keepdims=True) + 1.0)
            for level in LEVELS[:2]:  # a level that a row has not leaves the wider one's prior
                have = np.nan_to_num(sums[level])
                prior = (have + PRIOR_ROWS * prior) / (have.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            logs = logs + np.log(prior)
            for level, values in zip(LEVELS[2:], (n_declared, n_suffix), strict=True):
                # how often rows of a language come with this value, one more count for each value there is
                logs = logs + np.nan_to_num(np.log((sums[level] + 1.0) / (every + values + 1.0)))
            power = np.exp(logs - logs.max(axis=1, keepdims=True))
            seen = batch.column("grams").to_numpy() > 0
            named = lambda m: pa.array([names[i] if s else UNKNOWN for i, s in zip(m.argmax(axis=1), seen, strict=True)], pa.string())
            sure = np.where(seen, np.round(power.max(axis=1) / power.sum(axis=1), 6), 0.0)
            others = [x for x in batch.schema.names if x not in ("loglik", "soft", *LEVELS)]
            columns = [*[batch.column(x) for x in others], named(soft), named(logs), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "text_lang", "lang", "confidence"])

    return run


def _sums(name: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(name)[i]) for i in range(k)])


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    id_col: str,
    text_col: str,
    declared_col: str | None = None,
    url_col: str | None = None,
    host_col: str | None = None,
    from_html: bool = False,
    rows: bool = False,
    evidence: int = EVIDENCE,
) -> DataFrame:
    """id, declared, suffix, host, grams, text_lang, lang and confidence of every row; with `rows` also its input row as `row`.

    A text counts as at most `evidence` trigrams, whatever its length, all of which are looked at: more make long texts surer against their
    declaration and host, which then only decide short ones. `from_html` takes the main text of a page and its declared language from the markup. A null or malformed address, host or declared
    language is no evidence. A text without letters (null and empty ones too) is "und" with confidence 0. Repeated rows and
    null ids are rows of their own.
    """
    languages, table = model
    names, k = [*languages, UNKNOWN], len(languages) + 1
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    if from_html:
        declared = F.regexp_extract(F.col(text_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)) if url_col else F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    parts = F.split("host", r"\.")
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.nullif(F.lower(F.trim(F.split(declared, "[-_]")[0])), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if rows else F.col(text_col).alias("text"),
    )
    fields = "id long, declared string, host string" + (f", row {base.schema['row'].dataType.simpleString()}" if rows else "")
    scored = _likelihoods(table, from_html, text_col if rows else None, evidence)
    base = base.mapInArrow(trimmed(scored), fields + ", loglik array<double>, soft array<double>, grams long")
    suffix = F.when(F.size(parts) > 1, F.element_at(parts, -1)) if url_col else F.lit(None).cast("string")
    domain = F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host"))
    base = stage(base.withColumns({"suffix": suffix, "domain": domain}), "language_rows")

    hosts = stage(base.where("host is not null").groupBy("host", "domain").agg(_sums("soft", k).alias("host_sums")), "language_hosts")
    domains = hosts.groupBy("domain").agg(_sums("host_sums", k).alias("domain_sums"))
    by_declared = stage(base.where("declared is not null").groupBy("declared").agg(_sums("soft", k).alias("declared_sums")), "language_declared")
    by_suffix = stage(base.where("suffix is not null").groupBy("suffix").agg(_sums("soft", k).alias("suffix_sums")), "language_suffix")
    n_hosts, n_declared, n_suffix = hosts.count(), by_declared.count(), by_suffix.count()
    total = base.agg(_sums("soft", k)).first()[0]  # one row

    wide = 16 * k + 128  # bytes of a row with two arrays of sums
    near = base.join(small(hosts.join(domains, "domain").drop("domain"), n_hosts, wide), "host", "left")
    near = near.join(small(by_declared, n_declared, wide), "declared", "left").join(small(by_suffix, n_suffix, wide), "suffix", "left")
    kept = ["id", "declared", "suffix", "host", *["row"] * rows, "grams"]
    near = near.select(*kept, "loglik", "soft", *LEVELS)
    fields = fields.replace("host string", "suffix string, host string")
    fuse = _fuse(names, np.array(total if total[0] is not None else [0.0] * k), n_declared, n_suffix)
    out = near.mapInArrow(trimmed(fuse), f"{fields}, grams long, text_lang string, lang string, confidence double")
    return out.select("id", "declared", "suffix", "host", "grams", "text_lang", "lang", "confidence", *["row"] * rows)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is identified with at least `least` confidence, with docs' columns.

    Rejected are texts without letters and texts that no language's model explains better than the flat one. A text that
    contradicts its declared language stays: the declaration is what is wrong. A text with letters whose label has no model
    stays too: nothing can be told of it.
    """
    model = train(docs, id_col, text_col, lang_col)
    if not model[0]:  # nothing is labelled: nothing can be told
        return docs
    out = identify(docs, model, id_col, text_col, declared_col=lang_col, host_col=host_col, rows=True)
    untold = F.col("declared").isNotNull() & ~F.col("declared").isin(model[0]) & (F.col("grams") > 0)
    return out.where(((F.col("lang") != UNKNOWN) & (F.col("confidence") >= least)) | untold).select("row.*")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    model = train(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = identify(read(spark, sf_dir, "pages"), model, "page_id", "html", url_col="url", from_html=True)
    return out.withColumnRenamed("id", "page_id")
