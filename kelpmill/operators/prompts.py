"""Blocks and messages for a model, and results from its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nullif_empty, or_empty
from .completions import parse_completion

# Chosen values: the systems' messages and the labels of _request_lines are worded for this library.
ASK_SYSTEM = "Answer from the given document chunks and graph context. Say so plainly if they are not enough."
TEMPLATE_SYSTEM = (
    "You design reusable templates for business data. Answer with one JSON object and nothing else: template_id (lower snake case, ending in _v1), entity_type (upper snake case), "
    "description (five lines) and attributes, a list of objects with name, type (string, number, boolean, date, enum, array or json), enum_values and required. "
    "Take fitting catalog candidates first. Use real names, no placeholders."
)
DESCRIPTION_SYSTEM = 'You describe a business domain. Answer with one JSON object: {"description": "one paragraph of plain prose"}.'


# The layout of the blocks and of the question's prompt, and what stands for empty ones.
def chunk_block(chunks: Column) -> Column:
    lines = F.transform(F.coalesce(chunks, F.array()), lambda c, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("] "), or_empty(c["text"])))
    return F.coalesce(nullif_empty(F.array_join(lines, "\n\n")), F.lit("No matching chunks found."))


def relationship_lines(relationships: Column) -> Column:
    """The lines of one page."""
    line = lambda r: F.concat(r["from_type"], F.lit("("), r["from_id"], F.lit(") -["), r["relationship"], F.lit("]-> "), r["to_type"], F.lit("("), r["to_id"], F.lit(")"))
    return F.array_join(F.transform(relationships, line), "\n")


def graph_texts(pages: DataFrame) -> DataFrame:
    """(entity_id, entity, n_relationships, graph): the one place where an entity's pages come together, as the text of its prompts, in order."""
    lines = F.struct("page", relationship_lines(F.col("relationships")).alias("lines"))
    texts = pages.groupBy("entity_id").agg(F.first("entity", ignorenulls=True).alias("entity"), F.sum(F.size("relationships")).alias("n_relationships"), F.array_sort(F.collect_list(lines)).alias("pages"))
    text = F.array_join(F.transform("pages", lambda p: p["lines"]), "\n")
    return texts.select("entity_id", "entity", "n_relationships", graph_block(text).alias("graph"))


def graph_block(lines: Column) -> Column:
    return F.coalesce(nullif_empty(lines), F.lit("No graph relationships found."))


def candidate_block(candidates: Column) -> Column:
    """One line for each candidate; lists are joined by commas in brackets, booleans are true or false."""
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    line = lambda c: F.concat(F.lit("- "), c["attribute_key"], F.lit(" ("), c["type"], F.lit(", required_default="), c["required_default"].cast("string"), F.lit(", enum_values="), listed(c["enum_values"]), F.lit(", tags="), listed(c["tags"]), F.lit(")"))
    return F.coalesce(nullif_empty(F.array_join(F.transform(candidates, line), "\n")), F.lit("No catalog attribute candidates available."))


def messages(system: str, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def ask_context(questions: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """questions with chunks, entity, n_relationships and graph, the text of the entity's pages; empty where there are none."""
    rows = questions.join(chunks, "question_id", "left").join(graph_texts(pages), "entity_id", "left")
    none = F.array().cast(rows.schema["chunks"].dataType)
    return rows.withColumns({"chunks": F.coalesce("chunks", none), "n_relationships": F.coalesce("n_relationships", F.lit(0)), "graph": graph_block(F.col("graph"))})


def with_ask_prompt(context: DataFrame, system: str = ASK_SYSTEM) -> DataFrame:
    user = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nDocument Chunks:\n"), chunk_block(F.col("chunks")), F.lit("\n\nGraph Context:\n"), F.col("graph"))
    return context.withColumn("messages", messages(system, user))


def _request_lines() -> Column:
    line = lambda label, c: F.concat(F.lit(label + ": "), or_empty(F.col(c)), F.lit("\n"))
    return F.concat(line("Name", "template_name"), line("Domain id", "domain_id"), line("Domain type", "domain_type"), line("Guidance", "description"))


def ask_results(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each question of asked (a context with messages): the answer, or error_code and error_detail, its chunks, and its graph: the entity and the count of
    its relationships, which are in the pages of entity_id and aren't copied to each question."""
    given = parse_completion(answers).select(F.col("request_id").alias("question_id"), F.col("content").alias("answer"), "error_code", "error_detail")
    return asked.join(given, "question_id", "left").select("question_id", "answer", "error_code", "error_detail", "entity_id", "chunks", F.struct("entity", "n_relationships").alias("graph"))


def with_template_prompt(requests: DataFrame, system: str = TEMPLATE_SYSTEM) -> DataFrame:
    """requests (template_name, domain_id, domain_type, description, candidates) with messages."""
    user = F.concat(_request_lines(), F.lit("Candidates:\n"), candidate_block(F.col("candidates")))
    return requests.withColumn("messages", messages(system, user))


def with_description_prompt(requests: DataFrame, system: str = DESCRIPTION_SYSTEM) -> DataFrame:
    return requests.withColumn("messages", messages(system, _request_lines()))
