"""A catalog folder as one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import hash_digits
from catalith.operators import catalog as C
from catalith.operators.rebuild import rebuild
from catalith.streaming.ingest import ingest_batch
from catalith.tables import table


class Engine:
    """Reads and jobs over the tables of one folder; every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    def ingest(self, uploads: DataFrame, any_text: bool = False) -> DataFrame:
        """The accepted uploads (id, supplier, body), each led back to the stored package or the upload with the same bytes."""
        stored = C.canonical_packages(self.table("packages", "id", "package_hash")).where(F.col("package_hash").isNotNull())
        return ingest_batch(uploads, stored.groupBy("package_hash").agg(F.min("canonical_id").alias("canonical_id")), any_text)

    def manifests(self, ids: DataFrame | None = None) -> DataFrame:
        """The manifests of all packages, or of those in ids (a column package_id)."""
        packages, files = self.table("packages"), self.table("package_files")
        if ids is not None:
            wanted = ids.select("package_id").distinct()
            packages = packages.join(wanted, packages["id"] == wanted["package_id"], "left_semi")
            files = files.join(wanted, "package_id", "left_semi")
        return C.manifests(packages, files, self.table("content_blobs"))

    def files(self, ids: DataFrame) -> DataFrame:
        """The known files of packages (package_id) or of single files (package_id and id) with size and place."""
        keys = [c for c in ("package_id", "id") if c in ids.columns]
        files = self.table("package_files").join(ids.select(*keys).distinct(), keys, "left_semi")
        return C.files_with_blobs(files, self.table("content_blobs"))

    def originals(self, ids: DataFrame) -> DataFrame:
        return self.files(ids).where(F.col("role") == "original")

    def lookup(self, hashes: DataFrame) -> DataFrame:
        """hash and the blob it names; hashes has a column hash, in any spelling; unknown ones are left out."""
        asked = hashes.select("hash", hash_digits(F.col("hash")).alias("h")).distinct()
        blobs = C.blobs(self.table("content_blobs"))
        return asked.join(blobs, asked["h"] == blobs["content_hash"]).drop("h")

    def supplier_stats(self) -> DataFrame:
        return C.supplier_stats(C.ingest_counters(self.table("packages"), self.table("package_files")))

    def kpis(self, segment_bytes: int) -> DataFrame:
        return C.kpis(C.flat_totals(self.table("content_blobs")), F.lit(segment_bytes))

    def rebuilt(self) -> dict[str, DataFrame]:
        """packages, package_files and content_blobs made anew from the journal and the segment index."""
        return rebuild(self.table("journal"), self.table("segment_index"))
