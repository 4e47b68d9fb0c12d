"""Conversations: history, recent context, entity timelines, topics, relevant turns.

A conversation may be of any length, so positions come from :func:`spread_row_number` or are pruned
per group before the shuffle; no list of a whole conversation is built unless its size is capped.
Messages: ``conv_id, turn, role, text``; entity rows: ``conv_id, turn_no, entity, ...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions.ordered import spread_row_number, spread_running, top_per_group

TURN_BUCKET = 10_000
MAX_TURNS = 10


def number_turns(rows: DataFrame, out: str = "turn_no") -> DataFrame:
    """Consecutive zero-based turn numbers per conversation, in ``turn`` order."""
    numbered = spread_row_number(rows, ["conv_id"], F.floor(F.col("turn") / TURN_BUCKET), ["turn"], out)
    return numbered.withColumn(out, F.col(out) - 1)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, ``rank`` 1 being the latest."""
    return top_per_group(messages, ["conv_id"], [F.desc("turn")], n)


def latest(messages: DataFrame, chars: int = 30) -> DataFrame:
    """Beginning of each conversation's last message."""
    return messages.groupBy("conv_id").agg(
        F.substring(F.max_by("text", "turn"), 1, chars).alias("latest"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


def user_conversations(messages: DataFrame, user_id: str) -> DataFrame:
    """A user's conversations, newest first, titled by the last message."""
    own = messages.where(F.col("user_id") == user_id)
    return own.groupBy("conv_id").agg(
        F.coalesce(F.substring(F.max_by("text", F.struct("ts", F.col("sender") == "bot")), 1, 30), F.lit("Untitled")).alias("latest"),
        F.max("created_at").alias("created_at"),
    ).orderBy(F.desc("created_at"), "conv_id")


def new_messages(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """A user and a bot message per exchange ``conv_id, user_id, query, response, ts``.

    A conversation keeps the time at which it was opened; a new one opens with its exchange.
    """
    pair = F.array(
        F.struct(F.lit("user").alias("sender"), F.col("query").alias("text")),
        F.struct(F.lit("bot").alias("sender"), F.col("response").alias("text")),
    )
    opened = messages.groupBy("conv_id").agg(F.min("created_at").alias("_opened"))
    return exchanges.join(opened, "conv_id", "left").select(
        "conv_id", "user_id", F.coalesce("_opened", "ts").alias("created_at"), F.explode(pair).alias("m"), "ts"
    ).select("conv_id", "user_id", "created_at", "m.sender", "m.text", "ts")


def append_exchange(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Messages with those of new exchanges added."""
    return messages.unionByName(new_messages(messages, exchanges))


def entity_timeline(entities: DataFrame) -> DataFrame:
    """Mentions, first and last turn and the last three confidences of each entity of a conversation."""
    counts = entities.groupBy("conv_id", "entity").agg(
        F.count(F.lit(1)).alias("mentions"), F.min("turn_no").alias("first_mention"), F.max("turn_no").alias("last_mention"))
    recent = top_per_group(entities, ["conv_id", "entity"], [F.desc("turn_no"), F.desc("confidence")], 3).groupBy("conv_id", "entity").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "confidence")), asc=False), lambda x: x["confidence"]).alias("confidence_trend"))
    return counts.join(recent, ["conv_id", "entity"])


def entity_mentions(entities: DataFrame) -> DataFrame:
    """Mentions and last mention of each entity over all conversations."""
    return entities.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.max("turn_no").alias("last_mention"))


def topic_turns(turns: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Turns per topic: keyword topics of the query plus the types of the turn's entities."""
    rows = turns.select("conv_id", "turn_no", F.explode(tx.topics(F.col("text"))).alias("topic"))
    if entities is not None:
        rows = rows.unionByName(entities.select("conv_id", "turn_no", F.lower("entity_type").alias("topic"))).distinct()
    return rows.groupBy("conv_id", "topic").agg(
        F.count(F.lit(1)).alias("turns"), F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"))


def relevant_turns(entities: DataFrame, num_turns: int = 3, top: int = 3) -> DataFrame:
    """For each turn, those of the ``num_turns`` before it that share entities, best overlap first.

    An equi-join on (conversation, entity, turn): every entity row is offered to the few turns that
    may look back at it, so the work is linear whatever the length of a conversation.
    """
    rows = entities.select("conv_id", "turn_no", "entity").distinct()
    sizes = rows.groupBy("conv_id", "turn_no").agg(F.count(F.lit(1)).alias("_n"))
    offered = rows.select(
        "conv_id", "entity", F.col("turn_no").alias("past_turn"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(num_turns)), lambda k: F.col("turn_no") + k)).alias("turn_no"))
    shared = rows.join(offered, ["conv_id", "turn_no", "entity"]).groupBy("conv_id", "turn_no", "past_turn").agg(F.count(F.lit(1)).alias("overlap"))
    scored = shared.join(sizes, ["conv_id", "turn_no"]).withColumn("relevance", F.col("overlap") / F.greatest("_n", F.lit(1)))
    return top_per_group(scored.drop("_n"), ["conv_id", "turn_no"], [F.desc("relevance"), F.asc("past_turn")], top)


def context_summary(turns: DataFrame, entities: DataFrame, topics: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One line per conversation: turns kept, up to five entities of the last three turns, topics.

    Topics are the few fixed ones plus entity types, so their list is short.
    """
    count = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn_no").alias("_last"))
    recent = entities.join(count.select("conv_id", "_last"), "conv_id").where(F.col("turn_no") > F.col("_last") - 3)
    names = top_per_group(recent.select("conv_id", "entity").distinct(), ["conv_id"], [F.asc("entity")], 5).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("entity")).alias("recent_entities"))
    tags = topics.groupBy("conv_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    none = F.array().cast("array<string>")
    out = count.join(names, "conv_id", "left").join(tags, "conv_id", "left").select(
        "conv_id", F.least("n", F.lit(max_turns)).alias("turns"), F.coalesce("recent_entities", none).alias("recent_entities"),
        F.coalesce("topics", none).alias("topics"))
    return out.withColumn("summary", F.format_string("%d turns. Recent entities: %s. Topics: %s.", "turns",
                                                     F.array_join("recent_entities", ", "), F.array_join("topics", ", ")))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def response_parts(entities: DataFrame, fused: DataFrame, overall: DataFrame, documents: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """Answer text per query from its entities, three best predictions, totals and document count."""
    by_type = entities.groupBy("query_id").agg(*[
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("concept_type") == t, F.col("display_name")))), ", ").alias(a)
        for t, a in (("DISEASE", "_d"), ("SYMPTOM", "_s"))])
    best = top_per_group(fused, ["query_id"], [F.desc("confidence"), F.asc("entity")], top)
    line = F.format_string("- %s: %s (uncertainty %s, %d sources)", "entity", percent(F.col("confidence")), percent(F.col("uncertainty")), "source_count")
    lines = best.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("_p"))
    found = documents.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = queries.select("query_id", "text").join(by_type, "query_id", "left").join(lines, "query_id", "left").join(
        overall.select("query_id", "overall_confidence", "overall_uncertainty"), "query_id", "left").join(found, "query_id", "left")
    labelled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    answer = F.concat_ws(
        "\n\n", labelled("Conditions mentioned: ", F.col("_d")), labelled("Symptoms mentioned: ", F.col("_s")),
        labelled("Findings:\n", F.col("_p")),
        F.when(F.col("_p").isNotNull(), F.concat(F.lit("Overall: confidence "), percent(F.col("overall_confidence")),
                                                 F.lit(", uncertainty "), percent(F.col("overall_uncertainty")))),
        F.when(F.col("_n") > 0, F.format_string("Sources: %d documents", "_n")),
    )
    return rows.select("query_id", F.when(answer == "", F.lit("No analysis is available for this question.")).otherwise(answer).alias("response"),
                       F.coalesce("_n", F.lit(0)).alias("documents"), F.coalesce("_p", F.lit("")).alias("findings"))


def turns_before(queries: DataFrame, messages: DataFrame, turns: int = 3) -> DataFrame:
    """The last ``turns`` messages before each question ``query_id, conv_id, turn``: ``earlier`` in order.

    An as-of join in linear work: questions and messages of a conversation are laid in one order, a
    question counts the messages before it, and meets the last ones by an equi-join on their numbers. A
    message of the question's own turn is not before it. A question without a conversation, a turn or
    earlier messages has no row.
    """
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")
    said = messages.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", line, F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(1).alias("_message"))
    asked = queries.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.lit(None).cast("string").alias("line"), "query_id", F.lit(0).alias("_message"))
    placed = spread_running(said.unionByName(asked), ["conv_id"], F.floor(F.col("turn") / TURN_BUCKET), ["turn", "_message", "line"],
                            F.col("_message").cast("bigint"), "_at")
    wanted = placed.where("_message = 0 and _at > 0").select(
        "query_id", "conv_id", F.explode(F.sequence(F.greatest(F.col("_at") - turns + 1, F.lit(1)), F.col("_at"))).alias("_at"))
    met = wanted.join(placed.where("_message = 1").select("conv_id", "_at", "line"), ["conv_id", "_at"])
    return met.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]).alias("earlier"))


def prompt_parts(queries: DataFrame, history: DataFrame, answers: DataFrame, turns: int = 3) -> DataFrame:
    """Prompt text per query: the turns before it in its conversation, the findings, the question."""
    recent = turns_before(queries, history, turns).select("query_id", F.array_join("earlier", "\n").alias("_h"))
    return queries.join(recent, "query_id", "left").join(answers.select("query_id", "findings"), "query_id", "left").select(
        "query_id",
        F.concat_ws("\n\n", F.lit("Answer with evidence, state how sure you are, and point to professional care."),
                    F.concat(F.lit("Earlier turns:\n"), "_h"), F.concat(F.lit("Evidence:\n"), F.nullif("findings", F.lit(""))),
                    F.concat(F.lit("Question:\n"), "text")).alias("prompt"))
