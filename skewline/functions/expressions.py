"""Column expressions of the engine: costs, capacities, norms, order statistics. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_cost(count: Column | str, width: Column | str) -> Column:
    """Padded-attention proxy of a group: samples times the square of its widest sample; 0 for none."""
    return F.when(col(count) == 0, F.lit(0)).otherwise(col(count) * col(width) * col(width)).cast("long")


def rank_cost(count: Column | str, width: Column | str, quadratic: Column | str, linear: Column | str, overhead: Column | str) -> Column:
    n, w = col(count).cast("double"), col(width).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(col(quadratic) * n * w * w + col(linear) * n * w + col(overhead))


def permits(count: Column | str, width: Column | str, max_samples: Column | str, max_padded_tokens: Column | str, max_attention_cells: Column | str) -> Column:
    """Whether a rank may hold so many samples of such a width; a null cap is none."""
    n, w = col(count), col(width)
    return (n <= col(max_samples)) & F.coalesce(n * w <= col(max_padded_tokens), F.lit(True)) & F.coalesce(n * w * w <= col(max_attention_cells), F.lit(True))


def tokens_per_second(tokens: Column | str, ms: Column | str) -> Column:
    return F.try_divide(col(tokens).cast("double"), col(ms)) * 1000


def padding_fraction(tokens: Column | str, padded: Column | str) -> Column:
    return 1 - F.try_divide(col(tokens).cast("double"), col(padded).cast("double"))


def rms_norm(x: Column | str, residual: Column | str, weight: Column | str | None = None, eps: float = 1e-6) -> Column:
    """Residual RMS normalisation of a vector: (x + r) / sqrt(mean((x + r)^2) + eps), times the weight."""
    added = F.zip_with(x, residual, lambda a, b: a.cast("double") + b.cast("double"))
    square = F.aggregate(added, F.lit(0.0), lambda s, v: s + v * v)
    scale = 1 / F.sqrt(square / F.size(added) + eps)
    out = F.transform(added, lambda v: v * scale)
    return out if weight is None else F.zip_with(out, weight, lambda a, w: a * w)


def padded(tokens: Column | str, length: int, fill: int) -> Column:
    """A sequence on the right filled up to `length`."""
    return F.concat(col(tokens), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(tokens))))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Text of flat fields with sorted keys and no blanks, for content identities."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def ordered_hash(order: Column, line: Column) -> Column:
    """Aggregate: SHA-256 over lines in the order of a key; a group's lines meet in one row."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("k"), line.alias("v"))))
    return F.sha2(F.array_join(F.transform(items, lambda x: x["v"]), "").cast("binary"), 256)


def verdict(lo: Column, hi: Column) -> Column:
    """What a confidence interval of a speedup says."""
    return F.when(lo.isNull(), "insufficient independent pairs for an interval").when(lo > 1, "candidate faster in sampled runs").when(hi < 1, "candidate slower in sampled runs").otherwise("interval includes no improvement")


def uniform_draw(*parts: Column) -> Column:
    """In [0, 1), from the first 32 bits of an MD5, so other SQL engines draw the same."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
