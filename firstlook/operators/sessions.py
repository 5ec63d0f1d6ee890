"""Question-and-answer sessions: recent history, prompts, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: messages of a session that are remembered.
HISTORY = 6
INSTRUCTIONS = """You answer questions about one table, named {df} in Spark SQL.

%s

Write one Spark SQL query over {df} that answers the question.
Reply with one JSON object and nothing else:
{"code": "<the query>", "answer": "<one sentence that answers the question>"}
"""


def recent_history(messages: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest ``keep`` messages of each session, from rows (session, turn, role, text).

    Ranks are limited inside each task before the shuffle, so a session with very many messages
    sends only ``keep`` of them per task.
    """
    newest = Window.partitionBy("session").orderBy(F.col("turn").desc())
    ranked = messages.select("session", "turn", "role", "text", F.row_number().over(newest).alias("_age"))
    return ranked.where(F.col("_age") <= keep).drop("_age")


def system_prompt(description: str) -> str:
    return INSTRUCTIONS % description


def prompts(messages: DataFrame, questions: DataFrame, description: str) -> DataFrame:
    """One prompt per question: instructions, recent history in order, and the question.

    ``questions`` has rows (session, question); the result (session, messages) holds an array of
    (role, content). A history has at most six messages, so the arrays stay small.
    """
    def message(role: Column | str, content: Column) -> Column:
        return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))

    history = recent_history(messages).groupBy("session").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("past")
    )
    past = F.transform(
        F.coalesce("past", F.array().cast("array<struct<turn:bigint,role:string,content:string>>")),
        lambda m: message(m["role"], m["content"]),
    )
    return questions.join(history, "session", "left").select(
        "session",
        F.concat(
            F.array(message("system", F.lit(system_prompt(description)))),
            past,
            F.array(message("user", F.col("question"))),
        ).alias("messages"),
    )


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``code``, ``answer`` and ``error`` parsed from JSON replies; a part that is no string becomes empty."""
    parsed = F.try_parse_json(F.col(reply))

    def text(field: str) -> Column:
        part = F.try_variant_get(parsed, f"$.{field}", "variant")
        is_text = F.schema_of_variant(part) == "STRING"
        return F.when(F.coalesce(is_text, F.lit(False)), F.try_variant_get(parsed, f"$.{field}", "string")).otherwise("")

    error = F.when(parsed.isNull(), "reply is not valid JSON").when(
        ~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "reply is not a JSON object"
    )
    return df.withColumns({"code": text("code"), "answer": text("answer"), "error": error})
