"""Readers of study metadata, split lists, boxes, images, predictions, thresholds and results."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.staging import same_keys, small, stage

METADATA = "image_id string, finding_labels string, follow_up int, patient_id string, age string, sex string, view string"
ALIASES = {"Infiltrate": "Infiltration"}  # fixed values


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """Study metadata from CSV with a header, columns by position; a missing file raises. Ids are strings."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def parsed_age(column: str = "age") -> Column:
    """Text as a number, such as 58 or 58.5; null for anything else."""
    v = F.trim(F.col(column)).try_cast("double")
    return F.when(~F.isnan(v), v)


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct image ids of a list with one in a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("image_id")).where("image_id <> ''").distinct()


def in_list(studies: DataFrame, ids: DataFrame) -> DataFrame:
    return studies.join(ids, "image_id", "left_semi")


def image_index(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """image_id and path of every .png below the folders; of equal names the one in the later folder.

    A folder that does not exist is warned of and left out; raises if there is no image at all.
    """
    found, jvm, conf = None, spark._jvm, spark._jsc.hadoopConfiguration()
    for place, folder in enumerate(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(conf).exists(path):
            warnings.warn(f"no folder {folder}", stacklevel=2)
            continue
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder)
        files = files.select("path", F.lit(place).alias("place"))
        found = files if found is None else found.unionByName(files)
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"no .png files in {', '.join(folders) or 'no folders'}")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.groupBy(name.alias("image_id")).agg(F.max_by("path", F.struct("place", "path")).alias("path"))


def with_files(studies: DataFrame, index: DataFrame, least: float = 0.5) -> DataFrame:
    """Studies that have a file, with its path; raises if that is less than `least` of them."""
    joined = studies.join(index, "image_id", "left")
    rate = joined.agg(F.avg(F.col("path").isNotNull().cast("double"))).first()[0]
    if rate is None or rate < least:
        raise ValueError(f"only {rate or 0:.1%} of the studies have a file")
    return joined.where("path IS NOT NULL")


def read_boxes(spark: SparkSession, path: str, classes: Sequence[str], aliases: Mapping[str, str] = ALIASES) -> tuple[DataFrame, DataFrame]:
    """Boxes of known classes as image_id, finding, x, y, w, h, and the names that are not classes with their counts.

    The CSV's first six columns are taken by position, whatever their names; further ones are left out.
    """
    raw = spark.read.option("header", True).csv(path)
    first = raw.columns[:6]
    named = raw.select(F.col(f"`{first[0]}`").alias("image_id"), F.trim(F.col(f"`{first[1]}`")).alias("finding"), *[F.col(f"`{c}`").try_cast("double").alias(k) for c, k in zip(first[2:], "xywh")])
    named = named.replace(dict(aliases), subset=["finding"]) if aliases else named
    known = F.coalesce(F.col("finding").isin(list(classes)), F.lit(False))
    return named.where(known), named.where(~known).groupBy("finding").count()


def scale_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes from an image's own size (image_width, image_height) to a grid."""
    x, y = F.lit(width) / F.col("image_width"), F.lit(height) / F.col("image_height")
    return boxes.withColumns({"x": F.col("x") * x, "w": F.col("w") * x, "y": F.col("y") * y, "h": F.col("h") * y})


def annotated(boxes: DataFrame, studies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes with their study's columns, the first row of a study that occurs twice, and the boxes without a study."""
    columns = [c for c in studies.columns if c != "image_id"]
    at = studies.withColumn("__row", F.monotonically_increasing_id())  # rows of a file keep their order
    once = at.groupBy("image_id").agg(F.min_by(F.struct(*columns), "__row").alias("__s")).select("image_id", "__s.*")
    return boxes.join(once, "image_id"), boxes.join(once, "image_id", "left_anti")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels and data of the images below a folder."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def pixel_histogram(images: DataFrame, bins: int = 50) -> DataFrame:
    """Pixels in each of `bins` equal parts of 0 to 255; parts without pixels are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(256, dtype=np.int64)
            for data in batch.column(0):
                if data.is_valid:
                    total += np.bincount(np.frombuffer(data.as_buffer(), dtype=np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256) * bins // 256, pa.int32()), pa.array(total)], ["bin", "n"])

    return images.select("data").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")


def read_predictions(spark: SparkSession, path: str, experiment: str, model: str, split: str) -> DataFrame:
    """Rows of one saved run and split; only its folder is read. Raises if there are none."""
    p = spark.read.parquet(path).where((F.col("experiment") == experiment) & (F.col("model") == model) & (F.col("split") == split))
    if p.isEmpty():
        raise FileNotFoundError(f"no predictions of {experiment}:{model} on {split} in {path}")
    return p


def parse_member(spec: str) -> tuple[str, str]:
    """experiment:model as a pair; raises on anything else."""
    parts = [p.strip() for p in spec.split(":")]
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"{spec!r} is not experiment:model")
    return parts[0], parts[1]


def to_wide(pred: DataFrame, keys: Sequence[str] = ("study_id", "patient_id")) -> DataFrame:
    """A row for each study with `classes`, and `labels` and `scores` in their order."""
    cells = F.array_sort(F.collect_list(F.struct("class_idx", "label", "score")))
    return pred.groupBy(*keys).agg(cells.alias("c")).select(*keys, F.col("c.class_idx").alias("classes"), F.col("c.label").alias("labels"), F.col("c.score").alias("scores"))


def to_long(wide: DataFrame) -> DataFrame:
    """A row for each study and class; the classes are those of the column `classes`, or else the places in the arrays."""
    rest = [c for c in wide.columns if c not in ("labels", "scores", "classes")]
    place = F.posexplode(F.arrays_zip("labels", "scores")).alias("place", "c")
    cells = wide.select(*rest, *(["classes"] if "classes" in wide.columns else []), place)
    klass = F.get("classes", F.col("place")) if "classes" in wide.columns else F.col("place")
    return cells.select(*rest, klass.alias("class_idx"), F.col("c.labels").alias("label"), F.col("c.scores").alias("score"))


def read_results(spark: SparkSession, path: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """experiment, model, the whole document as `doc` (VARIANT), and the wanted fields of every run's results.

    path: a folder with experiment/results/model_results.json in it, or a pattern of such files. fields: for each field, a dot between nested names, its type
    (any of Spark's, nested ones too); its column has _ for the dot and is null where a run has no such field or it does not fit. No schema is inferred, so that runs
    with other fields, or an integer where others have a fraction, meet. Files that are no JSON are warned of and left out.
    """
    reader = spark.read
    if "*" not in path:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*_results.json")
    r = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).withColumn("doc", F.try_parse_json("value"))
    broken = r.where("doc is null").agg(F.count("*").alias("n"), F.min("file").alias("first")).first()
    if broken.n:
        warnings.warn(f"{broken.n} results are no JSON, {broken.first} among them", stacklevel=2)
    name = F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    wanted = [F.try_variant_get("doc", f"$.{k}", t).alias(k.replace(".", "_")) for k, t in (fields or {}).items()]
    named = F.regexp_extract(name, r"([^/]+)/results/[^/]+$", 1).alias("experiment"), F.regexp_extract(name, r"([^/]+)_results\.json$", 1).alias("model")
    return r.where("doc is not null").select(*named, "doc", *wanted)


def report_rows(spark: SparkSession, path: str, types: str) -> DataFrame:
    """The rows of the reports that sinks.write_report wrote, with experiment and model; types: the rows' columns, such as `metric string, value double`."""
    r = read_results(spark, path, {"rows": f"array<struct<{', '.join(t.strip().replace(' ', ': ', 1) for t in types.split(','))}>>"})
    return r.select("experiment", "model", F.inline("rows"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Saved thresholds with their status and the settings they were tuned under; values rounded to 4 places, as reports have them."""
    t = spark.read.parquet(path)
    return t.withColumn("threshold", F.round("threshold", 4))


def with_train_size(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """results with `train_images` of their experiment, null where it has no summary. summaries: experiment, split, n."""
    sizes = summaries.where("split = 'train'").groupBy("experiment").agg(F.max("n").alias("train_images"))
    return results.join(sizes, "experiment", "left")


def mean_image_size(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("n"), F.avg("width").alias("width"), F.avg("height").alias("height"))


def patient_violations(pred: DataFrame, studies: DataFrame) -> DataFrame:
    """study_id, the predictions' patient as `own` and the metadata's patient_id of the studies where they differ; null without metadata."""
    p = pred.select("study_id", F.col("patient_id").alias("own")).distinct().join(studies.select("study_id", "patient_id").distinct(), "study_id", "left")
    return p.where(~F.col("own").cast("string").eqNullSafe(F.col("patient_id").cast("string")))


def check_patients(pred: DataFrame, studies: DataFrame) -> None:
    """Raise unless every study of the predictions has metadata with the same patient."""
    n = patient_violations(pred, studies).count()
    if n:
        raise ValueError(f"{n} studies have no metadata or another patient there")


def member_violations(pred: DataFrame) -> DataFrame:
    """split, study_id and class_idx of the cells that not all runs score once with one label and one patient, with what they have of each."""
    at = ["split", "study_id", "class_idx"]
    names = [r.run_id for r in pred.select("run_id").distinct().collect()]  # a row for each run
    runs = len(names)
    if runs < 63 and dict(pred.dtypes)["patient_id"] in ("int", "bigint"):
        # sets of all cells would be sorted for; bits and extremes pick the cells that may differ
        bit = F.get(F.array(*[F.lit(1 << i).cast("long") for i in range(runs)]), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("run_id")).cast("int") - 1)
        ends = [F.min(c).eqNullSafe(F.max(c)) & F.max(c).isNotNull() for c in ("label", "patient_id")]
        same = (F.count("*") == runs) & (F.bit_or(bit) == (1 << runs) - 1) & ends[0] & ends[1]
        odd = stage(pred.groupBy(*at).agg(same.alias("same")).where("not coalesce(same, false)").select(*at), "odd_cells")
        pred = same_keys(pred, small(odd, odd.count()), at, "left_semi")
    cells = pred.groupBy(*at).agg(
        F.size(F.collect_set("run_id")).alias("runs"), F.count("*").alias("rows"), F.size(F.collect_set("label")).alias("labels"),
        F.size(F.collect_set(F.col("patient_id").cast("string"))).alias("patients"))
    return cells.where((F.col("runs") < runs) | (F.col("rows") > runs) | (F.col("labels") != 1) | (F.col("patients") != 1))


def check_members(pred: DataFrame) -> None:
    """Raise unless all runs score the same cells with the same labels and patients."""
    bad = member_violations(pred).limit(1).collect()
    if bad:
        raise ValueError(f"runs differ on study {bad[0].study_id}, class {bad[0].class_idx}: {bad[0].runs} runs, {bad[0].rows} rows, {bad[0].labels} labels, {bad[0].patients} patients")
