"""The example index as Parquet in versions.

Layout, per embedder: ``<path>/embedder=<name>/data-<id>`` (Parquet, written once and never
changed) and ``<path>/embedder=<name>/_versions/<n>.json``, the list of the data folders that make
up version n.  A version is published by renaming its finished file into place, after its data is
written: a write that fails leaves the versions before it as they were, and readers of a version never
see rows of a later one.  Rows carry the example text, the vector, its dimension and the rerank
features (lang, method_name, param_count) computed once at build time.

``append`` embeds only examples that the index does not hold yet, told by a digest of their
text.  A dimension that differs is an error, never a reason to rebuild.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import with_code_features
from ..operators.layout import spread
from .corpus import read_corpus, with_example_ids


def build_index(corpus: DataFrame, embedder) -> DataFrame:
    """V2 + C1-C3 over a corpus of (focal_method, unit_test, metadata)."""
    df = corpus if "example_id" in corpus.columns else with_example_ids(corpus)
    df = with_code_features(embedder.transform(spread(df), "focal_method", "embedding"), "focal_method")
    return df.select(
        "example_id",
        "focal_method",
        "unit_test",
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
        "embedding",
        "lang",
        "method_name",
        "param_count",
        F.lit(embedder.name).alias("embedder"),
        F.size("embedding").alias("dim"),
    )


def example_digest() -> F.Column:
    """What makes two examples the same: both texts and the metadata."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("focal_method", "unit_test", "metadata")]
    return F.sha2(F.concat_ws("\u0000", *[F.sha2(p, 256) for p in parts]), 256)


class Store:
    """The versions of one embedder's index under a path."""

    def __init__(self, spark: SparkSession, path: str, embedder_name: str) -> None:
        self.spark = spark
        self.root = f"{path.rstrip('/')}/embedder={embedder_name}"
        self.embedder_name = embedder_name
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's list of data folders; the latest by default, None if there is none."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"no version {version} of the index at {self.root}")
        (row,) = self.spark.read.text(f"{self.root}/_versions/{version or known[-1]:09d}.json", wholetext=True).collect()
        return json.loads(row[0])

    def publish(self, tables: list[str], dim: int, base: int) -> int:
        """Makes version ``base + 1`` of these data folders; raises if someone else has made it meanwhile."""
        version = base + 1
        target = self._path(f"{self.root}/_versions/{version:09d}.json")
        draft = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "embedder": self.embedder_name, "dim": dim, "tables": tables}).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version} of the index at {self.root} was published by another writer")
        return version

    def rows(self, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{t}" for t in manifest["tables"]])

    def write(self, index: DataFrame, base: dict | None) -> int | None:
        """Writes rows as a new data folder and publishes them with the folders of ``base``; None if there are none."""
        table = f"data-{uuid.uuid4().hex}"
        index.write.mode("errorifexists").parquet(f"{self.root}/{table}")
        dims = [r["dim"] for r in self.spark.read.parquet(f"{self.root}/{table}").select("dim").distinct().limit(3).collect()]
        if not dims:
            return None
        known = [base["dim"]] if base else []
        if len(set(dims + known)) > 1:
            raise ValueError(f"index for {self.embedder_name!r} would mix dimensions {sorted(set(dims + known))}")
        return self.publish([*(base["tables"] if base else []), table], dims[0], base["version"] if base else (self.versions() or [0])[-1])


def save_index(index: DataFrame, path: str, embedder_name: str) -> int | None:
    """A new version that holds these rows only."""
    store = Store(index.sparkSession, path, embedder_name)
    return store.write(index, None)


def append(corpus: DataFrame, path: str, embedder) -> int | None:
    """A new version with the examples of ``corpus`` that the index lacks; only these are embedded.

    None if there is nothing to add.  Ids go on behind the largest one."""
    spark = corpus.sparkSession
    store = Store(spark, path, embedder.name)
    base = store.manifest()
    if base and base["dim"] != embedder.embedding_dim:
        raise ValueError(f"index dimension {base['dim']} != embedder dimension {embedder.embedding_dim}")
    corpus = corpus.withColumn("metadata", F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in corpus.columns else F.lit("{}"))
    new = corpus.withColumn("_digest", example_digest()).dropDuplicates(["_digest"])
    after = -1
    if base:
        held = store.rows(base)
        new = new.join(held.select(example_digest().alias("_digest")).distinct(), "_digest", "left_anti")
        after = held.agg(F.max("example_id")).first()[0]
    rows = with_example_ids(new.drop("_digest", "example_id")).withColumn("example_id", F.col("example_id") + F.lit(after + 1))
    return store.write(build_index(rows, embedder), base)


def load_index(spark: SparkSession, path: str, embedder_name: str, expected_dim: int | None = None, version: int | None = None) -> DataFrame:
    """The rows of an embedder's index, the latest version by default; raises if there is none or
    its dimension is not ``expected_dim``."""
    store = Store(spark, path, embedder_name)
    manifest = store.manifest(version)
    if manifest is None:
        raise FileNotFoundError(f"no index of {embedder_name!r} at {path}")
    if expected_dim is not None and manifest["dim"] != expected_dim:
        raise ValueError(f"index dimension {manifest['dim']} != embedder dimension {expected_dim}")
    return store.rows(manifest)


def build_or_load(spark: SparkSession, index_path: str, corpus_path: str, embedder, max_examples: int = 0) -> DataFrame | None:
    """Reuse a stored index for this embedder, else build it from the
    corpus and store it.  An empty corpus gives None."""
    if not Store(spark, index_path, embedder.name).versions():
        corpus = read_corpus(spark, corpus_path, max_examples)
        if save_index(build_index(corpus, embedder), index_path, embedder.name) is None:
            return None
    return load_index(spark, index_path, embedder.name, embedder.embedding_dim)


def index_size(index: DataFrame) -> int:
    """A13."""
    return index.count()


class ExampleIndex:
    """The example database as a DataFrame with the original's verbs."""

    def __init__(self, spark: SparkSession, embedder, rows: DataFrame | None = None):
        self.spark = spark
        self.embedder = embedder
        self.rows = rows

    def add_examples(self, corpus: DataFrame) -> "ExampleIndex":
        """Rows added after a build carry no vector until ``build``."""
        from .corpus import add_examples

        self.rows = corpus if self.rows is None else add_examples(self.rows, corpus)
        return self

    def build(self) -> "ExampleIndex":
        """Embeds the rows that have no vector; the others keep theirs."""
        made = ("embedding", "lang", "method_name", "param_count", "embedder", "dim")
        if "embedding" not in self.rows.columns:
            self.rows = build_index(self.rows, self.embedder)
            return self
        new = self.rows.where(F.col("embedding").isNull()).drop(*[c for c in made if c in self.rows.columns])
        held = self.rows.where(F.col("embedding").isNotNull())
        # rows that came without an id get one behind the largest
        after = held.agg(F.max("example_id")).first()[0]
        new = new.withColumn("example_id", F.coalesce(F.col("example_id"), F.monotonically_increasing_id() + F.lit((-1 if after is None else after) + 1)))
        self.rows = held.unionByName(build_index(new, self.embedder), allowMissingColumns=True)
        return self

    def save(self, path: str) -> None:
        save_index(self.rows, path, self.embedder.name)

    def load(self, path: str) -> "ExampleIndex":
        self.rows = load_index(self.spark, path, self.embedder.name, self.embedder.embedding_dim)
        return self

    @property
    def size(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    retrieval_method = "dense"

    def retrieve(self, queries: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
        """R1 for a table of (query_id, text): embed, exact top-k."""
        from ..operators.knn import dense_topk

        q = self.embedder.transform(queries, "text", "embedding").select("query_id", "embedding")
        return dense_topk(q, self.rows.select("example_id", "embedding"), k, metric)
