"""Documents in Parquet, with the version of the element format in the files' footers.

The version is metadata of the column ``kind``, which Spark keeps in the footer
of every file as part of the schema; so it costs no column, survives copying of
single files, and is there before any row is read. Columns come in the format's
order. Elements are sorted by document and place, since runs of orders and kinds
encode to almost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.schema import FIELDS
from folia.vocabulary import SPEC_VERSION

VERSION_KEY = "element_spec_version"


def stamped(rows: DataFrame, version: str = SPEC_VERSION) -> DataFrame:
    """Rows whose ``kind`` carries the version in its metadata."""
    return rows.withMetadata("kind", {**rows.schema["kind"].metadata, VERSION_KEY: version})


def version_of(rows: DataFrame) -> str | None:
    """The version that rows carry, or null."""
    return rows.schema["kind"].metadata.get(VERSION_KEY)


def write_elements(rows: DataFrame, path: str, doc_cols: list[str], mode: str = "errorifexists", codec: str = "zstd", row_group_bytes: int = 128 << 20, v2: bool = True, files: int | None = None) -> None:
    """Row form as Parquet files with the version in their footers, a document's rows together and in order.

    ``v2`` chooses the newer page format, whose encodings take orders as
    differences; ``row_group_bytes`` the size at which a row group ends;
    ``files`` how many files at most (default: the session's shuffle partitions).
    """
    other = [c for c in rows.columns if c not in (*doc_cols, "pos", *FIELDS)]
    dealt = rows.repartition(*([files] if files else []), *doc_cols).sortWithinPartitions(*doc_cols, "pos")
    writer = stamped(dealt.select(*doc_cols, "pos", *FIELDS, *other)).write.mode(mode)
    options = {"compression": codec, "parquet.block.size": row_group_bytes, "parquet.writer.version": "PARQUET_2_0" if v2 else "PARQUET_1_0", "parquet.bloom.filter.enabled": "false"}
    writer.options(**options).parquet(path)


def read_elements(spark: SparkSession, path: str, versions: tuple[str, ...] = (SPEC_VERSION,)) -> DataFrame:
    """Row form from :func:`write_elements`; raises ``ValueError`` for files without a version or with one that isn't among ``versions``.

    Spark takes the schema from one file's footer. Files of several versions in
    one folder are told by :func:`footer_versions`.
    """
    rows = spark.read.parquet(path)
    version = version_of(rows)
    if version not in versions:
        raise ValueError(f"{path}: elements of version {version}, not {' or '.join(versions)}")
    return rows


def footer_versions(spark: SparkSession, path: str) -> DataFrame:
    """(file, version) of every file of a path, from the footers alone, which are read where the tasks are."""
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")

    def work(batches):
        import json

        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for name in batch["file"].to_pylist():
                store, inner = pafs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as f:
                    meta = pq.read_metadata(f).metadata or {}
                fields = json.loads(meta.get(b"org.apache.spark.sql.parquet.row.metadata", b'{"fields":[]}'))["fields"]
                found.append(next((x["metadata"].get(VERSION_KEY) for x in fields if x["name"] == "kind"), None))
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(found, pa.string())], names=["file", "version"])

    return files.repartition("file").mapInArrow(work, "file string, version string")

