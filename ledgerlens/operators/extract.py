"""Language-model steps: prompts, providers, response parsing, summaries in two passes, resume rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, null_if_empty, collapse, snippet_hash, strip, truncate

NOTHING_RELEVANT = "Keine relevanten Inhalte gefunden."
MOCK = '{"status":"not_found","value_unscaled":null,"scale":null,"unit":null,"source_text":null}'
RESPONSE = "status string, value_unscaled double, scale double, unit string, source_text string"
EXTRACT = "Feld: {field} (Einheit {unit}), Seiten {start} bis {end}. Stichworte: {keywords}. {notes}\nAntworte als JSON mit status, value_unscaled, scale, unit, source_text.\n---\n{text}"
SUMMARISE = "Fasse Abschnitt {section} in Stichpunkten zusammen:\n{chunk}"
SYNTHESIS = "Verbinde diese Stichpunkte zu Abschnitt {section}:\n{bullets}"


def render(template: str, **values: Column) -> Column:
    """A template with its {names} replaced; values are not searched again."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def mock(prompts: DataFrame) -> DataFrame:
    """Every prompt answered with not_found."""
    return prompts.withColumn("raw", F.lit(MOCK)).withColumn("truncated", F.lit(False))


def request_hash(prompt: Column, model: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"))), 256)


def replay(responses: DataFrame, model: str) -> Callable[[DataFrame], DataFrame]:
    """A provider that answers from a table (request_hash, raw, incomplete_reason); unknown prompts get null."""
    known = responses.select(F.col("request_hash").alias("__h"), "raw", F.col("incomplete_reason").isNotNull().alias("truncated"))

    def run(prompts: DataFrame) -> DataFrame:
        p = prompts.withColumn("__q", request_hash(F.col("prompt"), model))
        return p.join(known, F.col("__q") == F.col("__h"), "left").withColumn("truncated", F.coalesce("truncated", F.lit(False))).drop("__q", "__h")

    return run


PROVIDERS: dict[str, Callable] = {"mock": lambda **_: mock, "replay": lambda responses, model="default": replay(responses, model)}


def provider(name: str, **options):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add status, value_unscaled, scale, unit, source_text, has_evidence, snippet_hash, error.

    df needs field_id and start_page.  A blank answer is not_found without evidence; invalid JSON
    or a scale that is not allowed sets error and not_found instead of ending the job.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    blank = strip(text) == ""
    r = F.from_json(text, RESPONSE)
    df = df.withColumn("__r", r)
    bad_json = ~blank & F.col("__r.status").isNull()
    bad_scale = F.col("__r.scale").isNotNull() & ~F.col("__r.scale").isin(1.0, 1e3, 1e6, 1e9)
    error = F.when(bad_json, "invalid response").when(bad_scale, "scale not allowed")
    fine = ~blank & error.isNull()
    cut = truncate(F.col("__r.source_text"))
    return (
        df.withColumn("error", error)
        .withColumn("status", F.when(fine, F.col("__r.status")).otherwise("not_found"))
        .withColumn("value_unscaled", F.when(fine, F.col("__r.value_unscaled")))
        .withColumn("scale", F.when(fine, F.col("__r.scale")))
        .withColumn("unit", F.when(fine, F.col("__r.unit")))
        .withColumn("source_text", F.when(fine, null_if_empty(collapse(cut))))
        .withColumn("has_evidence", fine)
        .withColumn("snippet_hash", F.when(fine, snippet_hash(cut, F.col("field_id"), F.col("start_page"))))
        .drop("__r")
    )


def summarise(sections: DataFrame, answer: Callable[[DataFrame], DataFrame], size: int = 12000, overlap: int = 800) -> DataFrame:
    """doc_id, section_id, summary: one pass, and chunks with a synthesis only where that was empty or cut off."""
    s = sections.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    first = answer(s.where("text != ''").withColumn("prompt", render(SUMMARISE, section=F.col("section_id"), chunk=F.col("text"))))
    done = first.withColumn("raw", strip(F.coalesce("raw", F.lit("")))).withColumn("again", F.col("truncated") | (F.col("raw") == ""))
    pieces = done.where("again").select("doc_id", "section_id", F.posexplode(chunks(F.col("text"), size, overlap)).alias("n", "chunk"))
    parts = answer(pieces.withColumn("prompt", render(SUMMARISE, section=F.col("section_id"), chunk=F.col("chunk")))).withColumn("raw", strip(F.coalesce("raw", F.lit(""))))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("raw") != "", F.struct("n", "raw")))), lambda x: x["raw"])
    joined = parts.groupBy("doc_id", "section_id").agg(texts.alias("parts")).withColumn("bullets", F.array_join("parts", "\n\n---\n\n"))
    many = answer(joined.where(F.size("parts") > 1).withColumn("prompt", render(SYNTHESIS, section=F.col("section_id"), bullets=F.col("bullets"))))
    many = many.select("doc_id", "section_id", F.coalesce(null_if_empty(strip(F.col("raw"))), F.col("bullets")).alias("summary"))
    few = joined.where(F.size("parts") <= 1).select("doc_id", "section_id", F.coalesce(null_if_empty(F.col("bullets")), F.lit(NOTHING_RELEVANT)).alias("summary"))
    blank = s.where("text = ''").select("doc_id", "section_id", F.lit(NOTHING_RELEVANT).alias("summary"))
    return done.where("not again").select("doc_id", "section_id", F.col("raw").alias("summary")).unionByName(many).unionByName(few).unionByName(blank)


def pending(listed: DataFrame, ingested: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents to process: of the first ``limit`` paths those that are ingested and have no output yet."""
    if limit is not None:
        listed = listed.orderBy("path").limit(limit)
    return listed.join(ingested.select("doc_id").distinct(), "doc_id", "left_semi").join(existing.select("doc_id").distinct(), "doc_id", "left_anti")


def first_processed(listed: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """Of the documents without output the first ``limit`` by path; skipped ones do not count, one is always taken."""
    todo = listed.join(existing.select("doc_id").distinct(), "doc_id", "left_anti")
    return todo.orderBy("path").limit(max(limit, 1))


def chunk_rows(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    return df.select(*keys, F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_no", "chunk"))


def with_running_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
