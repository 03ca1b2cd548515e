"""The song catalogue and its companion tables, expressed over the given parquet tables.

``Catalog`` is lazy: every attribute is a DataFrame over ``spark.read.parquet`` with an explicit
schema, so Catalyst prunes columns and pushes filters down to the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.functions.hashing import hash_fraction, seeded_hash

# The column layout of each source table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

FEATURES = ["tempo", "energy", "valence", "danceability"]


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than the session has slots one partition per slot.

    Word-level work on texts is bound by CPU; one small file would otherwise keep it in one task. A scan
    that already has enough splits, as any large corpus has, is left alone.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots, key) if scan.rdd.getNumPartitions() < slots else scan


class Catalog:
    """Named DataFrames over one folder of source tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def songs(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("song_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("artist"),
            F.col("p_type").alias("genre"),
            F.array(F.lower("p_type"), F.split("p_name", " ")[0]).alias("genres"),
            F.split("p_name", " ").alias("tags"),
            (F.lit(60.0) + F.lit(2.4) * F.col("p_size")).alias("tempo"),
            (F.col("p_size") / F.lit(50.0)).alias("energy"),
            (F.col("p_partkey") % 100 / F.lit(100.0)).alias("valence"),
            (F.col("p_partkey") * 7 % 100 / F.lit(100.0)).alias("danceability"),
            (F.col("p_partkey") % 12).cast("int").alias("song_key"),
            (F.col("p_partkey") % 2).cast("int").alias("song_mode"),
            F.col("p_retailprice").alias("popularity"),
            (F.lit(1960) + F.col("p_partkey") % 60).cast("int").alias("release_year"),
        )

    @cached_property
    def gappy_songs(self) -> DataFrame:
        """Songs with missing measurements, as a real feature extractor leaves them."""
        return self.songs.withColumns(
            {
                "tempo": F.when(F.col("song_id") % 11 != 0, F.col("tempo")),
                "energy": F.when(F.col("song_id") % 13 != 0, F.col("energy")),
                "valence": F.when(F.col("song_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("valence")),
                "release_year": F.when(F.col("song_id") % 19 != 0, F.col("release_year")),
            }
        )

    @cached_property
    def albums(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                F.col("l_orderkey").alias("album_id"),
                F.col("l_partkey").alias("song_id"),
                F.col("l_suppkey").alias("credited_artist"),
            )
            .distinct()
        )

    @cached_property
    def album_info(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("album_id"),
            F.col("o_orderdate").alias("release_date"),
            F.col("o_custkey").alias("publisher_id"),
        )

    @cached_property
    def artists(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id")
        )

    @cached_property
    def plays(self) -> DataFrame:
        o, li = self.table("orders"), self.table("lineitem")
        return o.join(li, o.o_orderkey == li.l_orderkey).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("song_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("l_quantity").alias("plays"),
        )

    @cached_property
    def lyrics(self) -> DataFrame:
        d, lab = spread(self.table("documents"), "doc_id"), self.table("labels")
        return d.join(lab, "doc_id", "left").select(
            F.col("doc_id").alias("song_id"),
            "text",
            "lang",
            F.col("source").alias("artist"),
            F.col("toxic").alias("explicit"),
            F.col("quality").alias("mood"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", "embedding")

    @cached_property
    def labelled(self) -> DataFrame:
        """Vectors with a learnable three-class label (low, middle, high first two coordinates)."""
        s = F.col("x")[0] + F.col("x")[1]
        return (
            self.vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
            .withColumn("label", F.when(s > 0.1, 2).when(s > -0.1, 1).otherwise(0))
            .select("vec_id", "label", "x")
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.vectors.select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("t", "x")).select(
            "clip", "t", F.col("x").cast("double").alias("x")
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.samples.select(
            "clip",
            F.floor(F.col("t") / 8).cast("int").alias("frame"),
            (F.col("t") % 8).cast("int").alias("bin"),
            F.abs("x").alias("value"),
        )

    @cached_property
    def onsets(self) -> DataFrame:
        hour = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) as int)")
        return (
            self.table("events")
            .groupBy(F.col("event_type").alias("clip"), hour.alias("t"))
            .agg(F.count("*").cast("double").alias("strength"))
        )

    @cached_property
    def beat_events(self) -> DataFrame:
        """Beat times without a number; ``rhythm.number_beats`` numbers them."""
        return self.table("events").select(F.col("user_id").alias("clip"), "event_id", "ts", "value")

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "user_id",
            "ts",
            F.col("event_type").alias("endpoint"),
            F.col("value").alias("latency_ms"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_error"),
        )

    @cached_property
    def request_docs(self) -> DataFrame:
        """One JSON request per logged event; the ``error`` endpoint logs cut-off documents."""
        doc = F.concat(
            F.lit('{"type":"'), F.col("event_type"),
            F.lit('","artist":"Brand#'), (F.col("user_id") % 25 + 1).cast("string"),
            F.lit('","k":'), (F.col("event_id") % 20).cast("string"),
            F.lit(',"match":["energy: 0.'), (F.col("user_id") % 10).cast("string"),
            F.lit('","valence: 0.'), (F.col("event_id") % 10).cast("string"),
            F.lit('"],"exclude":{"genre":["PROMO"],"year_range":[['),
            (F.lit(1960) + F.col("user_id") % 60).cast("string"),
            F.lit(","), (F.lit(1965) + F.col("user_id") % 60).cast("string"), F.lit("]]}}"),
        )
        cut = F.when(F.col("event_type") == "error", F.expr("left(doc, 20)")).otherwise(F.col("doc"))
        return self.table("events").select("event_id", "event_type", doc.alias("doc")).select("event_id", cut.alias("doc"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def preds(self) -> DataFrame:
        """Predictions of a deterministic stand-in classifier."""
        return self.vectors.select(
            "vec_id",
            F.col("label").alias("truth"),
            F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("pred"),
        )

    @cached_property
    def ballots(self) -> DataFrame:
        """Predictions of four models with a train/val/test split, in long form."""
        v = self.vectors.select("vec_id", F.col("label").alias("truth"))
        models = F.array(
            *[
                F.struct(
                    F.lit(name).alias("model"),
                    F.lit(i).alias("priority"),
                    F.when(F.col("vec_id") % step == 0, (F.col("truth") + i + 1) % 10).otherwise(F.col("truth")).alias("pred"),
                )
                for i, (name, step) in enumerate([("rf", 5), ("gb", 4), ("svm", 3), ("lr", 4)])
            ]
        )
        h = hash_fraction(seeded_hash("vec_id", 42))
        split = F.when(h < 0.8, "train").when(h < 0.9, "val").otherwise("test")
        return v.select("vec_id", "truth", split.alias("split"), F.inline(models))

    @cached_property
    def edges(self) -> DataFrame:
        song = F.concat(F.lit("song:"), F.col("song_id").cast("string"))
        s = self.songs
        return (
            s.select(F.concat(F.lit("artist:"), "artist").alias("src"), song.alias("dst"), F.lit("PERFORMED").alias("rel"))
            .unionByName(s.select(song.alias("src"), F.concat(F.lit("genre:"), "genre").alias("dst"), F.lit("HAS_GENRE").alias("rel")))
            .unionByName(
                self.table("lineitem")
                .select("l_partkey", "l_orderkey")
                .distinct()
                .select(
                    F.concat(F.lit("song:"), F.col("l_partkey").cast("string")).alias("src"),
                    F.concat(F.lit("album:"), F.col("l_orderkey").cast("string")).alias("dst"),
                    F.lit("IN_ALBUM").alias("rel"),
                )
            )
        )

    @cached_property
    def hierarchy(self) -> DataFrame:
        n, s = self.table("nation"), self.table("supplier")
        return n.select(
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"),
        ).unionByName(
            s.select(
                F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"),
                F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"),
            )
        )
