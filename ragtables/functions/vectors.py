"""Vector arithmetic on ``array<float>`` columns, computed in double inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, let
from .tokens import tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot / (|a| |b|); 0.0 when a vector is null or empty, lengths differ, or a norm is zero."""

    def body(v):
        A, B = v["a"], v["b"]
        ok = A.isNotNull() & B.isNotNull() & (F.size(A) > 0) & (F.size(A) == F.size(B))
        return F.when(ok, let(F.struct(dot(A, B).alias("d"), norm(A).alias("na"), norm(B).alias("nb")), lambda s: F.when(
            (s["na"] != 0) & (s["nb"] != 0), s["d"] / (s["na"] * s["nb"])).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))

    a, b = col_(a), col_(b)
    return let(F.struct(a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b")), body)


def cosine_of_known(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """E3 of vectors whose norms are known."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length_a != 0) & (length_b != 0)
    return F.when(ok, dot(a, b) / (length_a * length_b)).otherwise(F.lit(0.0))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector as array<float>; a zero vector stays as it is."""
    return let(
        F.struct(col_(v).cast("array<double>").alias("v")),
        lambda s: let(
            F.struct(s["v"].alias("v"), norm(s["v"]).alias("n")),
            lambda t: F.when(t["n"] == 0, t["v"].cast("array<float>")).otherwise(
                F.transform(t["v"], lambda x: (x / t["n"]).cast("float"))
            ),
        ),
    )


def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: the first 7 hex digits of its md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % F.lit(dim)).cast("int")


def hash_embed(text: Column | str, dim: int = 64) -> Column:
    """Offline stand-in for an embedding model: counts of hashed R1 tokens, L2-normalised.

    Counting uses native scans of the sorted bucket list (count of j = last position - first
    position + 1), so only ``dim`` lambda calls run per text instead of ``dim`` per token.
    """
    buckets = F.array_sort(F.transform(tokenize(text), lambda t: hash_bucket(t, dim)))

    def counts(v):
        b, rb, n = v["b"], v["rb"], F.size(v["b"])

        def count(j):
            first = F.array_position(b, j)
            return F.when(first > 0, (n - F.array_position(rb, j) + 2 - first).cast("double")).otherwise(F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), count)

    vec = l2_normalize(let(F.struct(buckets.alias("b"), F.reverse(buckets).alias("rb")), counts))
    return F.when(col_(text).isNotNull(), vec)
