"""Operator 9: token weights raked to source, language and topic marginals, then documents sampled by them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import apart, packed, staged, table

#: A marginal's target shares are the shares of its tokens to this power, made to sum to one.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
ROUNDS = 25
#: Cells that come to the driver at most; more are raked as a table.
CELLS = 200_000
UNKNOWN = "unknown"


def tokens_of(text: Column) -> Column:
    """Tokens of a text: its words, as spaces part them; none for null or nothing but spaces."""
    held = F.trim(F.coalesce(text, F.lit("")))
    return F.when(held == "", 0).otherwise(F.length(held) - F.length(F.replace(held, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The form that a text's characters show: a topic for tables without one."""
    t = F.coalesce(text, F.lit(""))
    marks = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (
        F.when(marks("|") * 40 > F.length(t), "table")
        .when(marks("!") * 40 > F.length(t), "exclamation")
        .when((marks("#") + marks("$") + marks("%") + marks("&")) * 40 > F.length(t), "symbols")
        .when(F.length(t) < 600, "short")
        .otherwise("prose")
    )


def share_of(column: str) -> Column:
    """A number in [0, 1) from the id: the first 32 bits of its MD5. Null ids count as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2.0**32


def with_cells(docs: DataFrame) -> DataFrame:
    """docs (text and what it has of source, lang and topic) with __mix_source, __mix_lang, __mix_topic and __mix_tokens."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in docs.columns else (topic_of(F.col("text")) if c == "topic" else F.lit(UNKNOWN))
    return docs.withColumns({f"__mix_{c}": held(c) for c in POWERS} | {"__mix_tokens": tokens_of(F.col("text"))})


def marginal_targets(own: dict[str, float], power: float, wanted: dict[str, float] | None = None) -> dict[str, float]:
    """The shares that a marginal's values are to have: those wanted, else the shares of `own` tokens to `power`.

    Wanted shares are scaled to sum to one over the values that have tokens; values that aren't named get none.
    """
    share = {k: wanted.get(k, 0.0) for k in own} if wanted is not None else {k: v**power for k, v in own.items()}
    whole = sum(share.values())
    if whole <= 0:
        raise ValueError("no value with a wanted share has tokens")
    return {k: v / whole for k, v in share.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], powers: list[float], rounds: int = ROUNDS, shares: list[np.ndarray | None] | None = None) -> np.ndarray:
    """Weights of the cells after `rounds` rounds of fitting each marginal's shares in turn, or less where a round
    changes no weight by over 1e-12 of it; they sum to the tokens. shares, where given, replace those of the powers."""
    total = tokens.sum()
    targets = []
    for k, (code, power) in enumerate(zip(codes, powers)):
        own = np.bincount(code, tokens)
        share = np.where(own > 0, own, 1) ** power * (own > 0) if shares is None or shares[k] is None else shares[k]
        targets.append(share / share.sum() * total)
    weight = tokens.astype(np.float64)
    for _ in range(rounds):
        before = weight
        for code, target in zip(codes, targets):
            own = np.bincount(code, weight)
            weight = weight * (target / np.where(own > 0, own, 1))[code]
        if (np.abs(weight - before) <= 1e-12 * before).all():
            break
    return weight


def gap(weight: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray | None]) -> float:
    """The largest difference between a value's share of the weights and the one wanted."""
    found = [np.abs(np.bincount(c, weight, len(s)) / max(weight.sum(), 1e-300) - s / s.sum()).max() for c, s in zip(codes, shares) if s is not None]
    return max(found, default=0.0)


def filled(ratio: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to ratio whose expected tokens are `budget`: cells that would pass one are kept
    whole, and the others share what is left. All ones where the budget is no less than the tokens."""
    whole = np.zeros(len(ratio), bool)
    while True:
        rest = budget - tokens[whole].sum()
        part = (ratio * tokens)[~whole].sum()
        scale = rest / part if part > 0 else 0.0
        over = ~whole & (ratio * scale >= 1) & (ratio > 0)
        if not over.any():
            return np.where(whole, 1.0, np.clip(ratio * scale, 0.0, 1.0))
        whole |= over


def rake_table(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The same for cells that are too many for the driver: each fitting is an aggregate and a join."""
    total = cells.agg(F.sum("tokens")).first()[0]
    keys = [f"__mix_{c}" for c in POWERS]
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    targets = {}
    for key, power in zip(keys, POWERS.values()):
        own = cells.groupBy(key).agg(F.sum("tokens").alias("own")).withColumn("share", F.pow("own", F.lit(power)))
        whole = own.agg(F.sum("share")).first()[0]
        targets[key] = staged(own.select(apart(key).alias("__mix_k"), (F.col("share") / whole * total).alias("target")), "targets")
    for _ in range(rounds):
        for key in keys:
            own = now.groupBy(key).agg(F.sum("weight").alias("own")).select(apart(key).alias("__mix_k"), "own")
            factor = own.join(targets[key], "__mix_k").select("__mix_k", (F.col("target") / F.col("own")).alias("factor"))
            now = now.withColumn("__mix_k", F.col(key)).join(factor, "__mix_k").withColumn("weight", F.col("weight") * F.col("factor")).select(*keys, "tokens", "weight")
        now = staged(now, "rake")
    return now


def calibrated(
    docs: DataFrame, *, cells_on_driver: int = CELLS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, tokens: str | None = None, budget: float | None = None, tolerance: float = 0.01
) -> DataFrame:
    """docs with __mix_probability: of its cell, the raked weight over the tokens, so scaled that the largest is one.

    targets: wanted shares by marginal and value, as {"lang": {"en": 0.7, "de": 0.3}}; other marginals follow POWERS.
    If the weights miss a wanted share by over `tolerance` after all rounds, the targets contradict each other, and
    that is an error. tokens: a column of token counts, else words are counted. budget: the tokens that the sample is to
    have; then cells that reach probability one are kept whole and the others scaled up, so that no small cell sets the
    rate of all. Both need their cells on the driver. Documents without tokens have probability one: they weigh nothing
    in any mixture.
    """
    keys = [f"__mix_{c}" for c in POWERS]
    rows = with_cells(docs)
    if tokens is not None:
        rows = rows.withColumn("__mix_tokens", F.coalesce(F.col(tokens).cast("long"), F.lit(0)))
    cells = staged(rows.filter("__mix_tokens > 0").groupBy(*keys).agg(F.sum("__mix_tokens").alias("tokens")), "cells")
    n = cells.count()
    if n <= cells_on_driver:
        held = cells.orderBy(*keys).collect()  # at most cells_on_driver rows
        if not held:
            return rows.withColumn("__mix_probability", F.lit(1.0))
        counts = np.array([r.tokens for r in held], np.float64)
        names, codes = zip(*(np.unique([r[k] for r in held], return_inverse=True) for k in keys))
        shares: list[np.ndarray | None] = []
        for c, values, code in zip(POWERS, names, codes):
            wanted = (targets or {}).get(c)
            own = dict(zip(values.tolist(), np.bincount(code, counts).tolist()))
            shares.append(np.array([marginal_targets(own, POWERS[c], wanted)[v] for v in values.tolist()]) if wanted is not None else None)
        weight = rake(counts, list(codes), list(POWERS.values()), rounds, shares)
        if (missed := gap(weight, list(codes), shares)) > tolerance:
            raise ValueError(f"the targets can't be met together: a share is missed by {missed:.3f}")
        ratio = weight / counts
        probability = ratio / ratio.max() if budget is None else filled(ratio, counts, budget)
        found = docs.sparkSession.createDataFrame([(*(r[k] for k in keys), float(p)) for r, p in zip(held, probability)], ", ".join(f"{k} string" for k in keys) + ", __mix_probability double")
        joined = rows.join(F.broadcast(found), keys, "left")
    elif targets or budget is not None:
        raise ValueError(f"targets and budgets need at most {cells_on_driver} cells, here are {n}")
    else:
        raked = rake_table(cells, rounds).withColumn("ratio", F.col("weight") / F.col("tokens"))
        most = raked.agg(F.max("ratio")).first()[0]
        found = raked.select(*[apart(k).alias(f"{k}_") for k in keys], (F.col("ratio") / most).alias("__mix_probability"))
        joined = rows.join(found, reduce(lambda a, b: a & b, [rows[k] == found[f"{k}_"] for k in keys]), "left")
    return joined.withColumn("__mix_probability", F.when(F.col("__mix_tokens") == 0, 1.0).otherwise(F.col("__mix_probability")))


def sample(docs: DataFrame, *, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, tokens: str | None = None, budget: float | None = None) -> DataFrame:
    """The rows of docs whose id's share lies below their probability; columns as they were, whatever their names.

    The choice depends on the id and the marginals alone, so repeated rows stay or go together and a retried task
    chooses alike. Null sources, languages and topics are a value of their own, `unknown`. Without a topic column the
    topic is the text's form. No rows give no rows. targets, tokens and budget are calibrated()'s.
    """
    needed = {c: F.col(c) for c in ("text", "doc_id", *POWERS, tokens) if c and c in docs.columns}
    return calibrated(packed(docs, **needed), rounds=rounds, targets=targets, tokens=tokens, budget=budget).filter(share_of("doc_id") < F.col("__mix_probability")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = calibrated(table(spark, sf_dir, "documents"))
    return held.select(
        "doc_id",
        F.col("__mix_topic").alias("topic"),
        F.col("__mix_tokens").alias("n_tokens"),
        F.round("__mix_probability", 6).alias("probability"),
        (share_of("doc_id") < F.col("__mix_probability")).alias("kept"),
    )


def _sql() -> str:
    keys = list(POWERS)
    text = "coalesce(text, '')"
    marks = lambda c: f"(length({text}) - length(replace({text}, '{c}', '')))"
    targets = ", ".join(f"t_{k} AS (SELECT {k}, pow(sum(tokens), {p}) / sum(pow(sum(tokens), {p})) OVER () * (SELECT sum(tokens) FROM cells) AS target FROM cells GROUP BY {k})" for k, p in POWERS.items())
    step = "SELECT n, source, lang, topic, tokens, weight FROM r WHERE n < " + str(ROUNDS)
    for k in keys:
        step = f"SELECT n, source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {k}) AS weight FROM ({step}) JOIN t_{k} USING ({k})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
    CASE WHEN trim({text}, ' ') = '' THEN 0 ELSE length(trim({text}, ' ')) - length(replace(trim({text}, ' '), ' ', '')) + 1 END AS tokens,
    CASE WHEN {marks('|')} * 40 > length({text}) THEN 'table' WHEN {marks('!')} * 40 > length({text}) THEN 'exclamation'
      WHEN ({marks('#')} + {marks('$')} + {marks('%')} + {marks('&')}) * 40 > length({text}) THEN 'symbols' WHEN length({text}) < 600 THEN 'short' ELSE 'prose' END AS topic
  FROM documents
), cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
{targets},
r AS (SELECT 0 AS n, source, lang, topic, tokens, tokens AS weight FROM cells UNION ALL SELECT n + 1, source, lang, topic, tokens, weight FROM ({step})),
p AS (SELECT source, lang, topic, weight / tokens / max(weight / tokens) OVER () AS p FROM r WHERE n = {ROUNDS}),
f AS (SELECT doc_id, topic, tokens, CASE WHEN tokens = 0 THEN 1.0 ELSE p END AS p FROM d LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, topic, CAST(tokens AS BIGINT) AS n_tokens, round(p, 6) AS probability, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM f
"""


SQL = _sql()
