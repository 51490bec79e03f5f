"""Operator 3, mixing sources to target weights: iterative proportional fitting in DataFrame functions only.

Documents are summed up to cells of (source, language, topic). Each round rakes the cells' token weights to the three
sets of targets in turn; a document is then sampled with its cell's weight over the largest weight, so that the expected
tokens of the sample have the target shares; or, with a budget of tokens, so many times that they make up the budget. A
step sums the cells over the values of a margin, combined before the shuffle. The sums of a margin of up to SMALL values
come back as a constant of the next expression; those of more values by a merge join, so that no task holds the cells of
a value. (Sums that are broadcast back cost a page of an executor's memory each, tens of MB, whatever their size.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few, lookup, unused

#: Where no targets are given: the corpus's own shares to this power, made to sum to one. Rounds of raking; seed of the draw.
TEMPER, ROUNDS, SEED = 0.9, 8, 7
MARGINS = ("source", "lang", "topic")
#: Values of a margin up to which its sums come by the driver.
SMALL = 1000
#: A null source, language or topic is a value of its own.
NONE = "(none)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A topic by what the text holds: license lines, contacts, tables; otherwise prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("icense"), "license").when(t.contains("@") | t.contains("+1 ("), "contact").when(t.contains("|"), "table").otherwise("prose")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) made from doc_id and seed; rows without doc_id share one."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def raked(cells: DataFrame, margins: tuple[str, ...] = MARGINS, *, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = 0.0) -> DataFrame:
    """cells (margins, tokens, ...) with weight, so that tokens * weight have the target shares of each margin, those of the last one exactly.

    targets: for any of the margins a table (value, share), a row a value. Shares are made to sum to one over the values that
    have tokens; those without a row have share 0, so nothing of them is sampled; values that no cell has are passed over. A
    margin without a table has its share of all tokens to the power temper as target. Rounds end before `rounds` where no
    share is further from its target than tolerance; margin_errors() tells how far they are. Cells without tokens keep the
    factors that other cells of their margins are given, 1 at first. Null values are "(none)".
    """
    cells = checkpointed(cells.fillna(NONE, subset=list(margins)))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    aims, small = [f"_aim_{m}" for m in margins], {}
    out = cells.withColumn("weight", F.lit(1.0))
    for m, aim in zip(margins, aims):
        own = cells.groupBy(m).agg(F.sum("tokens").alias("own"))
        if targets and m in targets:
            own = own.join(targets[m].select(F.coalesce("value", F.lit(NONE)).alias(m), F.col("share").cast("double").alias("share")), m, "left")
            share = F.coalesce("share", F.lit(0.0))
        else:
            share = F.pow(F.col("own") / F.lit(total or 1.0), F.lit(temper))
        table = checkpointed(own.select(m, F.when(F.col("own") > 0, share).otherwise(F.lit(0.0)).alias(aim)))
        small[m] = few(table, SMALL)
        power = table.agg(F.sum(aim)).first()[0] or 1.0
        table = table.withColumn(aim, F.col(aim) / F.lit(power) * F.lit(float(total)))
        out = out.join(F.broadcast(table) if few(table) else table, m)
    out = checkpointed(out)
    have = F.sum(F.col("weight") * F.col("tokens"))
    for _ in range(rounds):
        for m, aim in zip(margins, aims):
            out = _with_sums(out, m, have, small[m])
            out = out.withColumn("weight", F.when(F.col("_now") > 0, F.col("weight") * F.col(aim) / F.col("_now")).otherwise(F.col("weight"))).drop("_now")
        out = checkpointed(out)
        if tolerance > 0:
            worst = max(out.groupBy(m).agg(F.abs(have - F.first(aim)).alias("far")).agg(F.max("far")).first()[0] or 0.0 for m, aim in zip(margins, aims))
            if worst <= tolerance * total:
                break
    return out.select(*cells.columns, "weight")


def _with_sums(out: DataFrame, m: str, have: Column, small: bool) -> DataFrame:
    """out with _now, the sum `have` over the rows with its value of m."""
    sums = out.groupBy(m).agg(have.alias("_now"))
    if not small:
        return out.join(sums.hint("merge"), m)
    pairs = [F.lit(x) for r in sums.collect() for x in r]  # SMALL rows at most
    return out.withColumn("_now", F.try_element_at(F.create_map(*pairs), F.col(m)) if pairs else F.lit(0.0))


def margin_errors(fitted: DataFrame, targets: dict[str, DataFrame], total: float | None = None) -> DataFrame:
    """margin, value, share (of tokens * weight) and error (share less its target) for fitted cells of raked() and targets (value, share that sum to one)."""
    total = total or fitted.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0] or 1.0
    out = None
    for m, t in targets.items():
        own = fitted.groupBy(F.col(m).alias("value")).agg((F.sum(F.col("weight") * F.col("tokens")) / F.lit(total)).alias("share"))
        own = own.join(t.select("value", F.col("share").alias("target")), "value", "full").select(F.lit(m).alias("margin"), "value", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) - F.coalesce("target", F.lit(0.0))).alias("error"))
        out = own if out is None else out.unionByName(own)
    return out


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic_of: Column | None = None, *, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = 0.0, seed: int = SEED, budget: float | None = None) -> DataFrame:
    """docs with n_tokens, topic, weight (its cell's, raked), probability and sampled; columns of docs so named give way.

    budget: the tokens that the sample is to have, as expected. A cell's documents are then taken weight times a factor the
    same for all cells, which is their probability and may be over 1: each has the column repeats, that number's whole part,
    and one more with a chance of the rest. Texts of scarce sources are repeated, none is left out to match them; a budget
    without tokens to meet it gives no repeats. repeated() makes rows of them.

    targets holds tables (value, share) under "source", "lang" and "topic", any of them; see raked(). Null texts count as
    empty and have no tokens; their cell's weight holds for them too. Null source, lang and topic are the value "(none)".
    Equal doc_ids share one draw, rows without doc_id too. Texts of any length are counted whole. An empty table gives an
    empty result.
    """
    docs = docs.drop(*[c for c in ("weight", "probability", "sampled", "repeats") if c not in (source, lang)])
    c_source, c_lang, c_cell, c_topic = unused(docs, "source_of", "lang_of", "cell", "topic_of")
    of = {c_source: F.coalesce(F.col(source), F.lit(NONE)), c_lang: F.coalesce(F.col(lang), F.lit(NONE)), c_topic: F.coalesce(topic_of if topic_of is not None else topic(F.col(text)), F.lit(NONE)), "n_tokens": word_count(F.col(text))}
    rows = docs.withColumns(of).withColumn(c_cell, F.concat_ws("\x01", c_source, c_lang, c_topic))
    cells = rows.groupBy(F.col(c_cell).alias("cell"), F.col(c_source).alias("source"), F.col(c_lang).alias("lang"), F.col(c_topic).alias("topic")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    fitted = checkpointed(raked(cells, targets=targets, temper=temper, rounds=rounds, tolerance=tolerance))
    most, n, weighed = fitted.agg(F.max("weight"), F.sum("n"), F.sum(F.col("weight") * F.col("tokens"))).first()
    times = F.col("weight") / F.lit(most or 1.0) if budget is None else F.col("weight") * F.lit(budget / weighed if weighed else 0.0)
    table = checkpointed(fitted.select(F.col("cell").alias(c_cell), "n", "weight", times.alias("probability")))
    out = lookup(rows.withColumn("topic", F.col(c_topic)), table, c_cell, "n", F.monotonically_increasing_id(), n or 0, most=100_000)
    out = out.drop(c_source, c_lang, c_cell, c_topic)
    if budget is None:
        return out.withColumn("sampled", draw(F.col(doc_id), seed) < F.col("probability"))
    whole = F.floor("probability")
    out = out.withColumn("repeats", whole + (draw(F.col(doc_id), seed) < F.col("probability") - whole).cast("long"))
    return out.withColumn("sampled", F.col("repeats") > 0)


def repeated(sample: DataFrame) -> DataFrame:
    """A row for each of the repeats of the rows of mixed(), in place of that column: repeat, from 1 on. No row is shuffled."""
    once = sample.where("repeats > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("repeats", F.lit(1)))))
    return once.drop("repeats")


def oracle(temper: float = TEMPER, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL for op3's rows over documents."""
    steps = ["""d AS (SELECT doc_id, coalesce(source, '(none)') source, coalesce(lang, '(none)') lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT n_tokens,
  CASE WHEN contains(text, 'icense') THEN 'license' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END topic
  FROM documents)""", "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE tokens FROM d GROUP BY ALL)", "total AS (SELECT sum(tokens) total FROM c)"]
    for m in MARGINS:
        steps += [f"p_{m} AS (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens) / any_value(total), {temper}) ELSE 0 END p FROM c, total GROUP BY {m})", f"t_{m} AS (SELECT {m}, p / sum(p) OVER () * total t FROM p_{m}, total)"]
    steps.append("w0 AS (SELECT *, 1.0::DOUBLE weight FROM c)")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN sum(weight * tokens) OVER (PARTITION BY w.{m}) > 0 THEN weight * t / sum(weight * tokens) OVER (PARTITION BY w.{m}) ELSE weight END AS weight) FROM w{k} w JOIN t_{m} USING ({m}))")
            k += 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 9) weight, round(weight / (SELECT max(weight) FROM w{k}), 9) probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 16.0 ** 13 < weight / (SELECT max(weight) FROM w{k}) sampled
FROM d JOIN w{k} w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic"""
