"""Sections, subsections and their page spans, from heading hits and table-of-contents items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
CANDIDATES = 5
LOW_COVERAGE = 0.5


def candidates(hits: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The n smallest pages of each (doc_id, letter), with their rank; ties by hit_seq."""
    w = Window.partitionBy("doc_id", "letter").orderBy("page", "hit_seq")
    return hits.where(F.col("letter").isin(*LETTERS)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse(hits: DataFrame) -> DataFrame:
    """Greedy choice of a start page for A to E in order: doc_id, letter, start_page (null: missing), issue.

    For each letter the largest of its candidates at or after the last start; failing that, at or
    after the page before, clamped to the last start.  One row a document is folded, so the scan
    over the letters stays inside a single expression.
    """
    pages = candidates(hits).groupBy("doc_id").pivot("letter", list(LETTERS)).agg(F.array_sort(F.collect_list("page")))
    return _fold(pages)


def _fold(pages: DataFrame) -> DataFrame:
    state = F.struct(F.lit(1).alias("last"), F.array().cast("array<struct<letter: string, start_page: int, issue: string>>").alias("out"))
    per = F.array(*[F.struct(F.lit(x).alias("letter"), F.coalesce(F.col(x), F.array().cast("array<int>")).alias("pages")) for x in LETTERS])

    def step(a: Column, p: Column) -> Column:
        fit = F.filter(p["pages"], lambda x: x >= a["last"])
        near = F.filter(p["pages"], lambda x: x >= a["last"] - 1)
        best = F.array_max(F.when(F.size(fit) > 0, fit).otherwise(near))
        start = F.greatest(best, a["last"])
        issue = F.when(best.isNull(), F.concat(F.lit("Missing section "), p["letter"])).when(best < a["last"], F.concat(F.lit("Adjusted "), p["letter"], F.lit(" start to maintain order")))
        row = F.struct(p["letter"].alias("letter"), F.when(best.isNotNull(), start).cast("int").alias("start_page"), issue.alias("issue"))
        return F.struct(F.coalesce(start, a["last"]).cast("int").alias("last"), F.concat(a["out"], F.array(row)).alias("out"))

    return pages.select("doc_id", F.explode(F.aggregate(per, state, step, lambda a: a["out"])).alias("s")).select("doc_id", "s.*")


def section_spans(starts: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc_id, section, start_page, end_page; a section ends before the next chosen start, the last with the document."""
    w = Window.partitionBy("doc_id").orderBy("letter")
    s = starts.where("start_page is not null").withColumn("next", F.lead("start_page").over(w)).join(page_counts, "doc_id")
    end = F.greatest(F.col("start_page"), F.coalesce(F.col("next") - 1, F.col("page_count")))
    return s.select("doc_id", F.col("letter").alias("section"), "start_page", end.cast("int").alias("end_page"))


def coverage(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc_id, covered, coverage_ratio, issue of every document."""
    sums = sections.groupBy("doc_id").agg(F.sum(F.col("end_page") - F.col("start_page") + 1).alias("covered"))
    c = page_counts.join(sums, "doc_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    c = c.withColumn("coverage_ratio", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("page_count")), F.lit(0.0)))
    low = F.when(F.col("covered") == 0, "No sections detected").when(F.col("coverage_ratio") < LOW_COVERAGE, F.concat(F.lit("Low coverage: "), F.format_number("coverage_ratio", 2)))
    return c.select("doc_id", "covered", "coverage_ratio", low.alias("issue"))


SUBSECTION = r"(?i)^([A-E])\.(\d{1,2})(?:\.(\d{1,2}))?$"


def subsection_code(marker: Column) -> Column:
    """Normal form of a subsection marker such as ``b.2.1``, else null."""
    m = F.trim(marker)
    return F.when(m.rlike(SUBSECTION), F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, 2, 9)))


def subsection_spans(items: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section, code, title, start_page, end_page.

    items: doc_id, seq, page, title, left_marker.  Spans of neighbours may touch; codes sort as text.
    """
    i = items.withColumn("code", subsection_code(F.col("left_marker"))).where("code is not null").withColumn("section", F.substring("code", 1, 1))
    i = i.join(sections, ["doc_id", "section"]).where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    first = Window.partitionBy("doc_id", "code", "page").orderBy("seq")
    i = i.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    order = Window.partitionBy("doc_id", "section").orderBy("page", "code")
    end = F.least("end_page", F.coalesce(F.lead("page").over(order), F.col("end_page")))
    out = i.withColumn("last", end)
    return out.where(F.col("page") <= F.col("last")).select("doc_id", "section", "code", "title", F.col("page").alias("start_page"), F.col("last").alias("end_page"))


def trailing_section(sections: DataFrame, items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Sections with Z appended where an entry that is no E marker starts after the last section."""
    last = page_counts.join(sections.groupBy("doc_id").agg(F.max("start_page").alias("last_start")), "doc_id", "left").withColumn("last_start", F.coalesce("last_start", F.lit(0)))
    marker = F.trim(F.coalesce("left_marker", F.lit("")))
    own = marker.rlike(r"(?i)^(E\.\d|(Abschnitt|Teil|Kapitel)\s*E)")
    after = items.join(last, "doc_id").where((F.col("page") > F.greatest(F.lit(1), F.col("last_start"))) & ~own)
    z = after.groupBy("doc_id").agg(F.min_by("page", F.struct("page", "seq")).alias("z"), F.max("page_count").alias("page_count"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("section"))
    trimmed = sections.withColumn("rn", F.row_number().over(w)).join(z.select("doc_id", "z"), "doc_id", "left")
    trimmed = trimmed.select("doc_id", "section", "start_page", F.when((F.col("rn") == 1) & F.col("z").isNotNull(), F.col("z") - 1).otherwise(F.col("end_page")).cast("int").alias("end_page"))
    return trimmed.unionByName(z.select("doc_id", F.lit("Z").alias("section"), F.col("z").cast("int").alias("start_page"), F.col("page_count").cast("int").alias("end_page")))


def contract_violations(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc_id, violations (sorted, joined by ;) of documents whose sections break the contract.

    sections: doc_id, seq (list order), section, start_page, end_page.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    s = sections.join(page_counts, "doc_id").withColumn("before", F.lag("end_page").over(w)).withColumn("is_last", F.lead("seq").over(w).isNull())
    found = F.array(
        F.when(F.col("start_page") > F.col("end_page"), "start after end"),
        F.when((F.col("start_page") < 1) | (F.col("end_page") > F.col("page_count")), "outside document"),
        F.when(F.col("start_page") <= F.col("before"), "overlap"),
        F.when((F.col("section") == "Z") & ~F.col("is_last"), "Z not last"),
        F.when((F.col("section") == "Z") & (F.col("end_page") != F.col("page_count")), "Z must end with the document"),
    )
    rows = s.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    twice = s.groupBy("doc_id").agg(F.count_if(F.col("section") == "Z").alias("z")).where("z > 1").select("doc_id", F.lit("more than one Z").alias("v"))
    return rows.unionByName(twice).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("v")), ";").alias("violations"))


def resolve_field_spans(fields: DataFrame, documents: DataFrame, sections: DataFrame, subsections: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, field_id, start_page, end_page, note: the subsection of the hint, else the section of its letter, plus the offset."""
    hint = F.upper(F.substring("subsection_hint", 1, 1))
    f = fields.withColumn("letter", F.when(hint.isin(*LETTERS), hint).otherwise("E"))
    asked = documents.select("doc_id").crossJoin(F.broadcast(f))  # the field taxonomy is a short constant list
    sub = subsections.groupBy("doc_id", "code").agg(F.min(F.struct("start_page", "end_page")).alias("sub"))
    sec = sections.groupBy("doc_id", F.col("section").alias("letter")).agg(F.min(F.struct("start_page", "end_page")).alias("sec"))
    r = asked.join(sub, (asked["doc_id"] == sub["doc_id"]) & (asked["subsection_hint"] == sub["code"]), "left").drop(sub["doc_id"]).join(sec, ["doc_id", "letter"], "left").join(offsets, "doc_id", "left")
    span = F.coalesce("sub", "sec")
    shift = F.coalesce("offset_arabic", F.lit(0))
    return r.select("doc_id", "field_id", (span["start_page"] + shift).alias("start_page"), (span["end_page"] + shift).alias("end_page"), F.when(span.isNull(), "no_section").alias("note"))


def numbered_points(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, at, lo, hi, n: the n pages (distinct numbers) of the document up to each page, and up to lo - 1 and hi of each range.

    A page has no lo and hi.  Keys alone are sorted, once a document.
    """
    at = [F.col(x).cast("long") for x in ("lo", "hi")]
    points = pages.select("doc_id", F.col("page").cast("long").alias("at"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).where("at is not null").distinct()
    for end in (at[0] - 1, at[1]):
        points = points.unionAll(ranges.select("doc_id", end.alias("at"), at[0].alias("lo"), at[1].alias("hi")))
    upto = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("n", F.count(F.when(F.col("lo").isNull(), 1)).over(upto))


def pages_of_ranges(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, lo, hi, page: the page numbers that exist in each of the distinct ranges, each once.

    A range is turned into first to last place among its document's pages, so only what is in it is made.
    """
    points = numbered_points(ranges, pages)
    places = points.where("lo is not null").groupBy("doc_id", "lo", "hi").agg((F.min("n") + 1).alias("first"), F.max("n").alias("last")).where("first <= last")
    places = places.select("doc_id", "lo", "hi", F.explode(F.sequence("first", "last")).alias("n"))
    return places.join(points.where("lo is null").select("doc_id", "n", F.col("at").alias("page")), ["doc_id", "n"]).drop("n")


def pages_in_span(spans: DataFrame, pages: DataFrame, page_count: str | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """span columns plus text (pages joined by newline, in order) and n_pages; rows of one doc_id and span_id are one span.

    pages: doc_id, page, text.  With texts, pages need no text: texts(wanted) gives doc_id, page, text of
    the wanted (distinct doc_id, page).  A text is put together once for all spans of the same ranges.
    """
    keys = ["doc_id", "span_id"]
    lo, hi = F.greatest(F.lit(1), F.col("start_page")).cast("long").alias("lo"), F.col("end_page").cast("long").alias("hi")
    s = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(lo, hi))).alias("ranges"))
    asked = s.select("doc_id", "ranges").distinct().select("doc_id", "ranges", F.inline("ranges")).where("lo <= hi")
    found = pages_of_ranges(asked.select("doc_id", "lo", "hi").distinct(), pages.select("doc_id", "page"))
    texts = texts(found.select("doc_id", "page").distinct()) if texts else pages
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    joined = asked.join(found, ["doc_id", "lo", "hi"]).join(texts, ["doc_id", "page"]).groupBy("doc_id", "ranges").agg(text.alias("text"), F.count("*").alias("n_pages"))
    return s.join(joined, ["doc_id", "ranges"], "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"))
