"""Training data sets as samples: COCO, YOLO, class folders, ZIP archives.

All paths go through Spark's readers, so data sets may lie in any store Spark reads.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.schemas import SAMPLE
from auditlake.functions.tables import file_system, shared_folder, written
from auditlake.sources import files
from auditlake.sources import ledger as segmented

# Extensions taken for images.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
GLOB = "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}"
COCO = """images ARRAY<STRUCT<id: LONG, file_name: STRING, width: INT, height: INT, contributor_id: STRING, batch_id: STRING>>,
annotations ARRAY<STRUCT<id: LONG, image_id: LONG, category_id: INT, bbox: ARRAY<DOUBLE>>>, categories ARRAY<STRUCT<id: INT, name: STRING>>"""
EMPTY_MAP = "map()"


class DatasetError(ValueError):
    """A data set that can't be read as one."""


def images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, stem, ext[, content]) of all image files below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return d.select("path", F.regexp_extract(name, r"^(.*)\.[^.]+$", 1).alias("stem"), name.alias("name"), *(["content"] if content else []))


def _ordered(d: DataFrame, order: list) -> DataFrame:
    """Samples with idx from 0. Ranks are taken within ranges of the order and the ranges' sizes
    are added up, so that a listing of any length is spread; the ranged rows are
    written, as a second pass must see the same ranges."""
    ranged = written(d.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "samples")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.join(before, "range").withColumn("idx", F.col("before") + rank).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SAMPLE])


def _coco_parts(spark: SparkSession, annotation_file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images (p, ...), annotations (q, ...) and categories of an annotation file, in order of p and q. The file is read by many
    tasks, or by one where its store has no ranges."""
    if not files.known(annotation_file):
        j = spark.read.schema(COCO).json(annotation_file, multiLine=True)
        return j.select(F.posexplode("images").alias("p", "i")).select("p", "i.*"), j.select(F.posexplode("annotations").alias("q", "a")).select("q", "a.*"), j.select(F.explode("categories").alias("c")).select("c.*")
    kinds = {f.name: f.dataType.elementType for f in spark.createDataFrame([], COCO).schema}
    rows = written(files.json_elements(spark, annotation_file, tuple(kinds)), "annotations")
    part = lambda key, place: rows.where(F.col("key") == key).select(F.col("place").alias(place), F.from_json("element", kinds[key]).alias("x")).select(place, "x.*")
    return part("images", "p"), part("annotations", "q"), part("categories", "r")


def coco(spark: SparkSession, annotation_file: str, images_dir: str | None = None) -> DataFrame:
    """Images with their annotations in order; those whose file is neither in the image folder
    nor in its parent are left out, if a folder is given."""
    im, an, ca = _coco_parts(spark, annotation_file)
    an = an.select("q", "image_id", "category_id", "bbox")
    ca = ca.select(F.col("id").alias("category_id"), "name")
    labelled = an.join(ca, "category_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), "category_id")))
    per = labelled.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("q", "category_id", "name", "bbox"))).alias("l"))
    d = im.join(per, im["id"] == per["image_id"], "left")
    path = F.col("file_name")
    if images_dir:
        here = images_dir.rstrip("/")
        parent = here.rsplit("/", 1)[0]
        found = images(spark, parent).select("path", F.regexp_replace("path", r"^file:/+", "/").alias("plain"))
        keys = [(F.concat(F.lit(f"{p}/"), path), k) for k, p in enumerate((here, parent))]
        wanted = d.select("p", F.explode(F.array(*[F.struct(k.alias("plain"), F.lit(n).alias("n")) for k, n in keys])).alias("x")).select("p", "x.*")
        hit = wanted.join(found, "plain").groupBy("p").agg(F.min_by("path", "n").alias("found"))
        d, path = d.join(hit, "p"), F.col("found")
    empty = F.coalesce(F.size("l"), F.lit(0)) < 1
    d = d.select(
        "p", F.col("id").cast("string").alias("sample_id"), path.alias("path"), F.when(empty, F.array(F.lit(0))).otherwise(F.col("l.category_id")).alias("labels"), F.when(empty, F.array(F.lit("unlabeled"))).otherwise(F.col("l.name")).alias("label_names"),
        F.when(empty, F.array().cast("array<array<double>>")).otherwise(F.col("l.bbox")).alias("bounding_boxes"), F.coalesce("contributor_id", F.lit("contributor_default")).alias("contributor_id"), F.coalesce("batch_id", F.lit("batch_default")).alias("batch_id"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    return _ordered(d, ["p"])


def yolo(spark: SparkSession, folder: str) -> DataFrame:
    """Images with label lines `class x y w h` of a text file of the same stem, in `labels` or
    beside them, and contributor and batch of `<stem>.meta.json`."""
    root = folder.rstrip("/")
    im = images(spark, root)
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))
    lines = read("*.txt").select(F.regexp_replace("name", r"\.txt$", "").alias("stem"), F.posexplode(F.split("text", "\n")).alias("q", "line"))
    f = F.split(F.trim("line"), r"\s+")
    parsed = lines.select("stem", "q", F.get(f, F.lit(0)).try_cast("double").cast("int").alias("label"), F.transform(F.slice(f, 2, 4), lambda x: x.try_cast("double")).alias("box"), F.size(f).alias("n")).where("n >= 5 and label is not null and not exists(box, x -> x is null)")
    per = parsed.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("q", "label", "box"))).alias("l"))
    meta = read("*.meta.json").select(F.regexp_replace("name", r"\.meta\.json$", "").alias("stem"), F.from_json("text", "contributor_id string, batch_id string").alias("m"))
    d = im.join(per, "stem", "left").join(meta, "stem", "left")
    empty = F.col("l").isNull()
    d = d.select(
        F.col("stem").alias("sample_id"), "path", F.when(empty, F.array(F.lit(0))).otherwise(F.col("l.label")).alias("labels"), F.when(empty, F.array(F.lit("unlabeled"))).otherwise(F.transform("l.label", lambda x: F.concat(F.lit("class_"), x))).alias("label_names"),
        F.when(empty, F.array().cast("array<array<double>>")).otherwise(F.col("l.box")).alias("bounding_boxes"), F.coalesce("m.contributor_id", F.lit("contributor_default")).alias("contributor_id"), F.coalesce("m.batch_id", F.lit("batch_default")).alias("batch_id"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    return _ordered(d, ["path"])


#: First bytes of files that can be images, and of those that Spark's image reader doesn't decode.
MAGIC = r"^(FFD8FF|89504E470D0A1A0A|424D|52494646.{8}57454250)"
UNREAD = r"^52494646.{8}57454250"


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, decodes): whether the pixels of each file can be read, all of them."""
    d = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).option("dropInvalid", "false").load(folder)
    return d.select(F.col("image.origin").alias("path"), (F.col("image.height") > 0).alias("decodes"))


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """Adds digest and accepted to (content, claimed): whether the content has the digest that its sender claims."""
    digest = F.sha2("content", 256)
    return uploads.withColumns({"digest": digest, "accepted": F.coalesce(digest == F.lower("claimed"), F.lit(False))})


def store_upload(spark: SparkSession, content: bytes, claimed: str, name: str, folder: str) -> str:
    """Writes accepted content to a folder of any store, under the last part of its name; other content is refused."""
    import hashlib

    if hashlib.sha256(content).hexdigest() != claimed.lower():
        raise DatasetError("the content does not have the digest claimed")
    fs, path = file_system(spark, f"{folder.rstrip('/')}/{os.path.basename(name) or 'upload'}")
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """A class for each subfolder, numbered in order of name; a flat folder is class 0. Files that
    don't begin as an image does, or whose pixels can't be read, are marked corrupt (of WebP the beginning alone is
    looked at)."""
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^file:/+", "/")
    d = images(spark, folder, content=True).select("path", "stem", F.regexp_replace("path", r"^file:/+", "/").alias("plain"), F.hex(F.substring("content", 1, 16)).alias("head"))
    below = F.split(F.substr("plain", F.length(root) + 2), "/")
    d = d.withColumn("cls", F.when(F.size(below) > 1, F.get(below, F.lit(0))))
    plain = F.regexp_replace("path", r"^file:/+", "/")
    whole = decoded(spark, folder).select(plain.alias("plain"), "decodes").groupBy("plain").agg(F.bool_or("decodes").alias("decodes"))
    d = d.join(whole, "plain", "left")
    bad = ~F.col("head").rlike(MAGIC) | (~F.col("head").rlike(UNREAD) & ~F.coalesce("decodes", F.lit(False)))
    d = d.withColumn("k", F.coalesce("cls", F.lit("")))
    # ranked over the class names alone, which are few
    ranks = d.select("k").distinct().withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1)
    label = F.col("label")
    d = d.join(ranks, "k").select(
        "path", F.when(bad, F.concat(F.lit("CORRUPT_"), "stem")).when(F.col("cls").isNull(), F.col("stem")).otherwise(F.concat_ws("_", "cls", "stem")).alias("sample_id"), F.array(F.when(bad, F.lit(-1)).otherwise(label)).alias("labels"), F.array(F.when(bad, F.lit("corrupted")).otherwise(F.coalesce("cls", F.lit("class_0")))).alias("label_names"),
        F.array().cast("array<array<double>>").alias("bounding_boxes"), F.lit("contributor_default").alias("contributor_id"), F.lit("batch_default").alias("batch_id"), F.create_map(F.lit("is_corrupted"), F.when(bad, "true").otherwise("false")).alias("metadata"), "k",
    )
    return _ordered(d, ["k", "path"])


def unpacked(spark: SparkSession, archive: str, into: str | None = None) -> str:
    """Extracts a ZIP archive into a folder, by default one of the shared folder, which all executors read. Members are written by
    tasks, by ranges; entries that would leave the folder, and content without its check sum, are refused."""
    target = into or f"{shared_folder(spark)}/zip-{uuid.uuid4().hex}"
    if not (files.known(archive) and files.known(target)):
        return _copied(spark, archive, target, not into)
    listing = written(files.zip_listing(spark, archive), "zip-listing")
    bad = listing.where("member is null").count()
    if bad or listing.isEmpty():
        raise DatasetError("not a ZIP archive" if bad else "the archive is empty")
    names = listing.select("member").mapInPandas(lambda pdfs: (p[p["member"].map(files.outside)] for p in pdfs), "member string").first()
    if names:
        raise DatasetError(f"the archive has an entry outside of its folder: {names[0]}")
    fault = written(files.unzipped(spark, archive, target, listing), "zip-written").where("error is not null").first()
    if fault:
        raise DatasetError(f"not a whole ZIP archive: {fault['member']}: {fault['error']}")
    if not into:
        fs, place = file_system(spark, target)
        fs.deleteOnExit(place)
    return target


def _copied(spark: SparkSession, archive: str, target: str, passing: bool) -> str:
    """As unpacked(), by way of the driver, for stores that only Spark reads."""
    fs, path = file_system(spark, archive)
    hadoop = spark._jvm.org.apache.hadoop.fs
    with tempfile.TemporaryDirectory(prefix="auditlake-zip-") as local:  # the driver alone reads it
        fs.copyToLocalFile(False, path, hadoop.Path(f"file://{local}/archive"), True)
        try:
            with zipfile.ZipFile(f"{local}/archive") as z:
                names = [n for n in z.namelist() if not n.endswith("/")]
                if not names:
                    raise DatasetError("the archive is empty")
                if any(map(files.outside, names)):
                    raise DatasetError(f"the archive has an entry outside of its folder: {next(filter(files.outside, names))}")
                z.extractall(f"{local}/files")
        except zipfile.BadZipFile as e:
            raise DatasetError("not a ZIP archive") from e
        out, place = file_system(spark, target)
        out.mkdirs(place.getParent())
        out.copyFromLocalFile(True, True, hadoop.Path(f"file://{local}/files"), place)
        if passing:
            out.deleteOnExit(place)
    return target


def sniff(spark: SparkSession, folder: str) -> tuple[str, str | None]:
    """(format, annotation file) of a folder of any store: COCO, then YOLO, then class folders. JSON
    files are read by executors, piece by piece where their store has ranges; the first by path that is one of annotations wins."""
    listed = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    jsons, words = listed("*.json").where(~F.col("path").endswith(".meta.json")), ("images", "categories", "annotations")
    if files.known(folder):
        has = files.holding(jsons, tuple(f'"{w}"'.encode() for w in words))
    else:
        has = jsons.select("path", F.array(*[F.contains(F.col("content").cast("string"), F.lit(f'"{w}"')) for w in words]).alias("has"))
    found = has.where("has[0] and has[1] or has[2]").agg(F.min("path")).first()[0]
    if found:
        return "coco", found
    if not listed("*.txt").where(F.contains("path", F.lit("/labels/"))).select("path").isEmpty():
        return "yolo", None
    return "folders", None


def load(spark: SparkSession, path: str, format: str = "auto", annotation_file: str | None = None) -> DataFrame:
    """Samples of a data set in any of the formats."""
    if path.endswith(".zip"):
        path = unpacked(spark, path)
    if format == "auto":
        format, found = ("coco", annotation_file) if annotation_file else sniff(spark, path)
        annotation_file = annotation_file or found
    if format == "coco":
        folder = f"{path.rstrip('/')}/images"
        fs, place = file_system(spark, folder)
        return coco(spark, annotation_file, folder if fs.exists(place) else path)
    if format == "yolo":
        return yolo(spark, path)
    if format in ("folders", "classification"):
        return class_folders(spark, path)
    raise DatasetError(f"unknown format {format}")


def inference_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records as JSON lines, static or as a stream."""
    from auditlake.functions.schemas import RECORD

    return (spark.readStream if stream else spark.read).schema(RECORD).json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ledger: a file or folder of JSON lines, or the committed segments of ledger.append()."""
    fs, place = file_system(spark, f"{path.rstrip('/')}/commits")
    if fs.exists(place):
        return segmented.entries(spark, path)
    return spark.read.schema("seq long, previous_hash string, timestamp string, finding string, entry_hash string").json(path)
