"""Tables that rows are only added to, once a key, at the cost of what is added.

An insert writes its rows as a piece: Parquet files by partition value, and for each partition value a Bloom filter of
the keys, as bitmaps of Spark's own bitmap functions. The next insert looks its keys up in the filters, reads the keys of
only those partitions of pieces that a filter hits, and appends what is absent. Nothing that is stored is written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import _delete, _exists, absent

#: Bits of a filter for each key, and bits that a key sets. One absent key in some five thousand is looked for in vain.
BITS_A_KEY, PROBES = 32, 4
#: Bits of one of Spark's bitmaps: the least size of a filter.
BITMAP_BITS = 32_768


@dataclass(frozen=True)
class Inserted:
    """What an insert did: rows added, files of earlier inserts whose keys were read, files of rows written."""

    rows: int
    files_read: int
    files_written: int


class KeyedStore:
    """A folder of pieces. ``keys`` name a row; ``partition`` is a column that depends on the keys alone, as a day of
    their time does. A row with a null in its key is in conflict with none and always added.

    A piece counts once its log file stands, and log files are numbered and created only if absent: an insert that
    fails leaves nothing that readers see, and of two inserts at once one fails and may be tried again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], *, partition: str) -> None:
        self.spark, self.folder, self.keys, self.partition = spark, folder.rstrip("/"), keys, partition

    @property
    def _paths(self):
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    # --- log --------------------------------------------------------------------------------------------------------
    def _log(self) -> list[dict]:
        """Entries of the log, oldest first: one for each insert since the last compaction, a short line each."""
        if not _exists(self.spark, f"{self.folder}/_log"):
            return []
        rows = self.spark.read.schema("n long, piece string, bits long, schema string, replaces array<string>, since string").json(f"{self.folder}/_log").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["n"])

    def _commit(self, log: list[dict], **entry) -> None:
        n = log[-1]["n"] + 1 if log else 1
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_log/{n:012d}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(json.dumps({"n": n, **entry}).encode()))
        out.close()

    @staticmethod
    def _pieces(log: list[dict]) -> dict[str, int]:
        """Current pieces with the bits of their filters."""
        gone = {p for e in log for p in e["replaces"] or []}
        return {e["piece"]: e["bits"] for e in log if e["piece"] and e["piece"] not in gone}

    @staticmethod
    def _since(log: list[dict]) -> str | None:
        return max((e["since"] for e in log if e["since"]), default=None)

    def pieces(self) -> int:
        """How many pieces the table consists of."""
        return len(self._pieces(self._log()))

    # --- reading ----------------------------------------------------------------------------------------------------
    def _rows(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*paths).drop("piece")

    @staticmethod
    def _schema(log: list[dict]) -> StructType:
        return StructType.fromJson(json.loads([e["schema"] for e in log if e["schema"]][-1]))

    def read(self) -> DataFrame:
        """All rows of the current pieces, those of dropped partitions left out."""
        log = self._log()
        pieces = self._pieces(log)
        if not pieces:
            raise ValueError(f"nothing is stored in {self.folder}")
        rows, since = self._rows([f"{self.folder}/rows/piece={p}" for p in pieces], self._schema(log)), self._since(log)
        return rows if since is None else rows.filter(F.col(self.partition).isNull() | (F.col(self.partition).cast("string") >= F.lit(since)))

    # --- filters ----------------------------------------------------------------------------------------------------
    def _positions(self, bits: Column) -> Column:
        """The places in a filter that a key sets, from two hashes."""
        a, b = F.pmod(F.xxhash64(*self.keys), bits), F.pmod(F.xxhash64(F.lit("second"), *self.keys), bits)
        return F.array_distinct(F.array(*(F.pmod(a + b * i, bits) for i in range(PROBES))))

    def _write_piece(self, rows: DataFrame, log: list[dict], **entry) -> int:
        """Write rows and their filters as a piece and commit it; the number of files of rows."""
        piece = uuid.uuid4().hex
        at = f"{self.folder}/rows/piece={piece}"
        rows.repartition(self.partition).write.partitionBy(self.partition).parquet(at)
        written = self._rows([at], rows.schema)
        most = written.groupBy(self.partition).count().agg(F.max("count")).first()[0] or 1
        bits = max(BITMAP_BITS, 1 << (BITS_A_KEY * most - 1).bit_length())
        places = written.select(self.partition, F.explode(self._positions(F.lit(bits))).alias("at"))
        maps = places.groupBy(self.partition, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
        maps.withColumn("slot", F.col(self.partition).cast("string")).drop(self.partition).repartition("slot").write.partitionBy("slot").parquet(f"{self.folder}/filters/piece={piece}")
        self._commit(log, piece=piece, bits=bits, schema=rows.schema.json(), **entry)
        return len(written.inputFiles())

    def _hit(self, keyed: DataFrame, pieces: dict[str, int]) -> list[str]:
        """Folders of the partitions of pieces whose filter holds one of the keys, at most so many as keys' partitions."""
        known = F.explode(F.array(*(F.struct(F.lit(p).alias("piece"), F.lit(b).alias("bits")) for p, b in pieces.items())))
        tried = keyed.select(self.partition, *[k for k in self.keys if k != self.partition], known.alias("p"))
        tried = tried.select("p.piece", F.col(self.partition).cast("string").alias("__slot"), F.xxhash64(*self.keys).alias("__key"), self._positions(F.col("p.bits")).alias("__at"))
        tried = tried.withColumn("__n", F.size("__at")).withColumn("__at", F.explode("__at")).withColumn("bucket", F.bitmap_bucket_number("__at"))
        maps = self.spark.read.schema("bucket long, map binary, piece string, slot string").option("basePath", f"{self.folder}/filters")
        maps = maps.parquet(*(f"{self.folder}/filters/piece={p}" for p in pieces)).withColumnRenamed("slot", "__slot")
        bit = F.bitmap_bit_position("__at")
        byte = F.conv(F.hex(F.substring("map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.call_function("getbit", byte, (bit % 8).cast("int")) == 1
        held = tried.join(maps, ["piece", "__slot", "bucket"]).filter(is_set).groupBy("piece", "__slot", "__key", "__n").count().filter("count = __n")
        found = held.select("piece", F.col("__slot").alias("slot")).distinct().collect()
        return [f"{self.folder}/rows/piece={r['piece']}/{self.partition}={self._paths.escapePathName(r['slot'])}" for r in found]

    # --- writing ----------------------------------------------------------------------------------------------------
    def insert(self, delta: DataFrame) -> Inserted:
        """Add the rows whose key is not stored, one for each key (of several any one). The same rows again add nothing
        and write no file. Rows of partitions that were dropped are not added either."""
        log = self._log()
        pieces, since = self._pieces(log), self._since(log)
        if since is not None:
            delta = delta.filter(F.col(self.partition).isNull() | (F.col(self.partition).cast("string") >= F.lit(since)))
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        keyed = delta.filter(whole & F.col(self.partition).isNotNull()).select(*dict.fromkeys([*self.keys, self.partition])).distinct()
        hit = self._hit(keyed, pieces) if pieces else []
        read, fresh = 0, absent(delta.limit(0), delta, self.keys)
        if hit:
            old = self._rows(hit, self._schema(log))
            read, fresh = len(old.inputFiles()), absent(old.select(*self.keys), delta, self.keys)
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        fresh.write.parquet(staged)  # decided once: what is written and what is counted are the same rows
        fresh = self.spark.read.schema(fresh.schema).parquet(staged)
        rows = fresh.count()
        written = self._write_piece(fresh, log) if rows else 0
        _delete(self.spark, staged)
        return Inserted(rows, read, written)

    def keep_since(self, since: str) -> int:
        """Drop the partitions below a value, by name and as text: no row is read or written. Returns the folders dropped.

        Readers see them no more once the log says so; the folders go afterwards. Rows without a value stay.
        """
        log = self._log()
        self._commit(log, since=since)
        dropped = 0
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for kind, name in (("rows", self.partition), ("filters", "slot")):
            for piece in self._pieces(log):
                base = fs_path(f"{self.folder}/{kind}/piece={piece}")
                for entry in base.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(base):
                    value = self._paths.unescapePathName(entry.getPath().getName().partition(f"{name}=")[2])
                    if value and value != "__HIVE_DEFAULT_PARTITION__" and value < since:
                        _delete(self.spark, entry.getPath().toString())
                        dropped += kind == "rows"
        return dropped

    def compact(self, most_pieces: int = 16) -> bool:
        """Make one piece of all, if there are more than so many: an insert probes the filters of each piece."""
        log = self._log()
        pieces = self._pieces(log)
        if len(pieces) <= most_pieces:
            return False
        self._write_piece(self.read(), log, replaces=list(pieces))
        return True
