"""Chunk configurations and knowledge-base profiles (K1-K3)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from pyspark.sql import types as T

# Strategies, retrieval methods and defaults of the settings.
CHUNK_STRATEGIES = ("fixed", "recursive", "semantic", "structure")
RETRIEVAL_METHODS = ("keyword", "vector", "rerank", "rrf")
DEFAULT_CHUNK_SIZE = 800
DEFAULT_CHUNK_OVERLAP = 120
DEFAULT_SEMANTIC_THRESHOLD = 0.75
DEFAULT_TOP_K = 4
DEFAULT_CANDIDATE_K = 12
DEFAULT_RRF_K = 60
DEFAULT_COLLECTION = "knowledge"
COLLECTION_NAME_REGEX = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,62}$"

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("collection_name", T.StringType()),
        T.StructField("chunk_strategy", T.StringType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("chunk_overlap", T.IntegerType()),
        T.StructField("semantic_chunk_threshold", T.DoubleType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed"
    size: int = DEFAULT_CHUNK_SIZE
    overlap: int = DEFAULT_CHUNK_OVERLAP
    threshold: float = DEFAULT_SEMANTIC_THRESHOLD

    def validate(self) -> "ChunkConfig":
        """K3: overlap below size, known strategy, threshold in (0, 1]."""
        if self.overlap >= self.size:
            raise ValueError("chunk overlap must be smaller than chunk size")
        if self.strategy not in CHUNK_STRATEGIES:
            raise ValueError(f"chunk strategy must be one of {CHUNK_STRATEGIES}")
        if not 0 < self.threshold <= 1:
            raise ValueError("semantic threshold must be in (0, 1]")
        return self


@dataclass(frozen=True)
class RetrievalConfig:
    method: str = "vector"
    top_k: int = DEFAULT_TOP_K
    candidate_k: int = DEFAULT_CANDIDATE_K
    rrf_k: int = DEFAULT_RRF_K

    def validate(self) -> "RetrievalConfig":
        """K3: known method, candidate_k >= top_k, rrf_k > 0."""
        if self.method not in RETRIEVAL_METHODS:
            raise ValueError(f"retrieval method must be one of {RETRIEVAL_METHODS}")
        if self.candidate_k < self.top_k:
            raise ValueError("candidate_k must be at least top_k")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")
        return self


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    collection_name: str
    chunk: ChunkConfig = ChunkConfig()
    enabled: bool = True

    def validate(self) -> "Profile":
        if not self.id.strip():
            raise ValueError("profile id must not be blank")
        if not self.name.strip():
            raise ValueError(f"profile {self.id}: name must not be blank")
        if not re.match(COLLECTION_NAME_REGEX, self.collection_name):
            raise ValueError(f"profile {self.id}: invalid collection name")
        self.chunk.validate()
        return self


def default_collection_name(base: str, strategy: str) -> str:
    return f"{base}-{strategy.replace('_', '-')}"[:63]


def default_profiles(base: str = DEFAULT_COLLECTION, chunk: ChunkConfig = ChunkConfig()) -> list[Profile]:
    """K1: one profile per strategy; only the first is enabled."""
    base = base or DEFAULT_COLLECTION
    return [
        Profile(
            id=f"kb-{s}",
            name=f"{s} 切分库",
            collection_name=default_collection_name(base, s),
            chunk=ChunkConfig(s, chunk.size, chunk.overlap, chunk.threshold),
            enabled=i == 0,
        )
        for i, s in enumerate(CHUNK_STRATEGIES)
    ]


def profiles_frame(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    rows = [
        (p.id, p.name, p.collection_name, p.chunk.strategy, p.chunk.size, p.chunk.overlap, float(p.chunk.threshold), p.enabled)
        for p in profiles
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA).withColumn("profile_ord", F.monotonically_increasing_id())


def profile_violations(profiles: DataFrame, registry_enabled: bool = True) -> DataFrame:
    """K2 as a table: one row per violated rule (profile id, rule). Empty when the registry is off."""
    p = profiles
    rules = [
        ("id_blank", F.length(strip(F.coalesce("id", F.lit("")))) == 0),
        ("name_blank", F.length(strip(F.coalesce("name", F.lit("")))) == 0),
        ("collection_name_invalid", ~F.coalesce(F.col("collection_name").rlike(COLLECTION_NAME_REGEX), F.lit(False))),
        ("overlap_not_below_size", F.col("chunk_overlap") >= F.col("chunk_size")),
        ("strategy_unknown", ~F.col("chunk_strategy").isin(*CHUNK_STRATEGIES)),
        ("threshold_out_of_range", ~((F.col("semantic_chunk_threshold") > 0) & (F.col("semantic_chunk_threshold") <= 1))),
    ]
    out = None
    for name, cond in rules:
        part = p.filter(cond).select(F.col("id"), F.lit(name).alias("rule"))
        out = part if out is None else out.unionByName(part)
    dup_ids = p.groupBy("id").count().filter("count > 1").select("id", F.lit("id_duplicate").alias("rule"))
    dup_coll = (
        p.groupBy("collection_name").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n > 1")
        .select("id", F.lit("collection_name_duplicate").alias("rule"))
    )
    none_enabled = (
        p.agg(F.count_if(F.col("enabled")).alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no_profile_enabled").alias("rule"))
    )
    out = out.unionByName(dup_ids).unionByName(dup_coll).unionByName(none_enabled)
    if not registry_enabled:
        out = out.limit(0)
    return out


def validate_profiles(profiles: DataFrame, registry_enabled: bool = True) -> None:
    """K2: raise when the profile table breaks a rule."""
    found = profile_violations(profiles, registry_enabled)
    shown = found.limit(21).collect()  # the message names 20 of them
    if shown:
        more = f"; and {found.count() - 20} more" if len(shown) > 20 else ""
        raise ValueError("invalid profiles: " + "; ".join(f"{r['id']}: {r['rule']}" for r in shown[:20]) + more)
