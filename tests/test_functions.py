"""Golden values of text, number, scale and verification rules."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.functions import scale as S
from ledgerlens.functions import text as T
from ledgerlens.operators import evaluate, extract, merge, pageoffset, report, spans, toc, verify


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("r")).head().r


def test_numbers_in_order(spark):
    text = "Wert: 1 312 850 und 1.111.111 sowie 12,5 und (133 333) und 391%."
    assert one(spark, N.numbers_de(F.col("t")), t=text) == [1312850.0, 1111111.0, 12.5, -133333.0, 391.0]


@pytest.mark.parametrize("text, pair", [("SCR 123 456 (133 333) TEUR.", (123456.0, 133333.0)), ("1.234.567 (1.111.111) EUR", (1234567.0, 1111111.0)), ("391% (389%)", None)])
def test_current_and_previous(spark, text, pair):
    got = one(spark, N.current_previous(F.col("t")), t=text)
    assert (tuple(got) if got else None) == pair


@pytest.mark.parametrize("raw, joined", [("Rück-\nstellung", "Rückstellung"), ("über -\närztlich", "überärztlich"), ("Kapi\ntal", "Kapital"), ("zwei\nZeilen", "zweiZeilen".replace("Z", "\nZ")), ("a  b\tc", "a b\tc"), ("So­lvenz", "Solvenz")])
def test_hyphenation(spark, raw, joined):
    assert one(spark, T.normalize_hyphenation(F.col("t")), t=raw) == joined


def test_snippet_hash(spark):
    import hashlib

    assert one(spark, T.snippet_hash(F.col("a"), F.col("b")), a="x", b=" ") == hashlib.sha1(b"x").hexdigest()[:16]
    assert one(spark, T.snippet_hash(F.col("a"), F.col("b")), a="x", b="y") == hashlib.sha1(b"x | y").hexdigest()[:16]
    assert one(spark, T.snippet_hash(F.col("a")), a="") == hashlib.sha1(b"empty").hexdigest()[:16]


def test_chunks_cover_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(997))
    parts = one(spark, T.chunks(F.col("t"), 100, 20), t=text)
    assert parts[0] + "".join(p[20:] for p in parts[1:]) == text and max(map(len, parts)) == 100
    assert one(spark, T.chunks(F.col("t"), 100, 20), t="short") == ["short"]
    with pytest.raises(ValueError):
        T.chunks(F.col("t"), 10, 10)


@pytest.mark.parametrize("text, value", [("xiv", 14), ("MCMXC", 1990), ("iiii", None), ("", None), ("vx", None), ("I", 1)])
def test_roman(spark, text, value):
    assert one(spark, T.roman_value(F.col("t")), t=text) == value


@pytest.mark.parametrize("source, scale", [("SCR 10 TEUR", 1e3), ("5 Mio. €", 1e6), ("3 Milliarden EUR", 1e9), ("7 Milliarde", None), ("12 EUR", 1.0), ("12 Euro", None), ("8 %", None), ("4 tsd", 1e3)])
def test_scale_from_source(spark, source, scale):
    got = one(spark, S.from_source(F.col("t")), t=source)
    assert (got.scale if got else None) == scale


def test_scale_near_beats_caption_and_row_beats_both(spark):
    page = "Angaben in TEUR\n" + "x" * 50 + " SCR 12 Mio"
    assert one(spark, S.infer(F.col("s"), F.col("p"), F.lit(None).cast("double")), s="SCR 12", p=page).scale == 1e6
    assert one(spark, S.infer(F.col("s"), F.col("p"), F.lit(None).cast("double")), s="SCR 12 EUR", p=page).scale == 1.0
    assert one(spark, S.from_caption(F.col("p")), p="Alle Beträge in EUR") is None


def test_verifier(spark):
    rows = [
        ("a", "ok", 10.0, "EUR", 1000.0, "SCR 10", True, 1e6),
        ("b", "ok", 10.0, "EUR", 1234.0, "SCR 10 TEUR", True, None),
        ("c", "ok", 999.0, "EUR", None, "SCR 123 456 TEUR.", True, None),
        ("d", "ok", 133333.0, "EUR", None, "SCR 123 456 (133 333) TEUR", True, None),
        ("e", "not_found", None, "EUR", None, None, False, None),
        ("f", "ok", 5.0, "EUR", None, None, True, None),
    ]
    df = spark.createDataFrame(rows, "id string, status string, value_unscaled double, unit string, scale double, source_text string, has_evidence boolean, typical_scale double").withColumn("page_text", F.lit(None).cast("string"))
    got = {r.id: r for r in verify.verify(df).collect()}
    assert (got["a"].value_canonical, got["a"].verified, got["a"].confidence) == (10000.0, True, 0.7)
    assert (got["b"].value_canonical, got["b"].verified) == (10000.0, True)
    assert not got["c"].verified and got["c"].verifier_notes == verify.NOT_FOUND and got["c"].confidence == 0.35
    assert not got["d"].verified and got["d"].verifier_notes == verify.PREVIOUS_YEAR
    assert got["e"].verifier_notes == verify.NO_VALUE and got["e"].confidence == 0.0
    assert got["f"].verified and got["f"].confidence == 0.6


def test_rounding_as_binary(spark):
    assert one(spark, N.round_half_even(F.col("x")), x=2.675) == 2.67
    assert one(spark, N.round_half_even(F.col("x")), x=1.005) == 1.0


def test_contents_parsing():
    assert toc.parse_section(["A. Geschäftstätigkeit ..... 7"]) == ("A", "Geschäftstätigkeit", 7)
    assert toc.parse_section(["B.", "Governance", "....", "12"]) == ("B", "Governance", 12)
    assert toc.parse_section(["A.1", "Thema", "9"]) is None
    assert toc.parse_section(["Teil C", "Risikoprofil", "20"]) == ("C", "Risikoprofil", 20)
    assert toc.parse_item(["a.1 Thema .... 5"]) == ("Thema", "A.1", 5)
    assert toc.parse_item(["E.2", "SCR und MCR", "…", "41"]) == ("SCR und MCR", "E.2", 41)
    assert toc.parse_item(["Anhang", "50"]) == ("Anhang", "", 50)
    assert toc.parse_item([]) is None and toc.parse_item(["nur Text"]) is None


def test_contents_markers():
    assert toc.parse_item(["A", "B.1 foo", "5"]) == ("B.1 foo", "A", 5)
    assert toc.parse_item(["A", "Geschäft", "7"]) == ("Geschäft", "A", 7)
    assert toc.parse_item(["A", ".", "Geschäft", "7"]) == ("Geschäft", "A.", 7)
    assert toc.parse_item(["A. Geschäft", "....", "7"]) == ("A. Geschäft", "", 7)
    assert toc.parse_item(["A.1 G", "eschäft", "....", "7"]) == ("G eschäft", "A.1", 7)
    assert toc.parse_item(["Teil B", "System", "12"]) == ("System", "Teil B", 12)
    assert toc.parse_item(["B.", "Governance……39"]) == ("Governance", "B.", 39)
    assert toc.parse_item(["B.", "Governance", "Teil zwei……39"]) == ("Governance", "B.", 39)
    assert toc.parse_item(["7"]) is None
    assert toc.parse_section(["A. Title 7", "A.1 x"]) == ("A", "Title", 7)
    assert toc.parse_section(["A.1 x", "A. Title 7"]) is None
    assert toc.parse_section(["A", ".", "Titel", "…", "7"]) == ("A", "Titel", 7)
    assert toc.parse_section(["7", "A.", "Titel"]) is None
    assert toc.parse_section(["A. Titel", "mit Rest", "…… 12"]) == ("A", "Titel mit Rest", 12)


def test_contents_lines_and_sections(spark):
    s = spark.createDataFrame([("d", 0, 0, "A. Eins", 10.0, 100.0), ("d", 0, 1, "2", 90.0, 101.5), ("d", 0, 2, "B. Zwei", 10.0, 120.0), ("d", 0, 3, "5", 90.0, 120.0)], "doc_id string, page_index int, span_seq int, text string, x0 double, y0 double")
    hits = toc.heading_hits(toc.lines(s))
    assert sorted((r.letter, r.page) for r in hits.collect()) == [("A", 2), ("B", 5)]
    starts = spans.fuse(hits)
    assert sorted(r.issue for r in starts.collect() if r.issue) == ["Missing section C", "Missing section D", "Missing section E"]
    counts = spark.createDataFrame([("d", 9)], "doc_id string, page_count int")
    assert sorted((r.section, r.start_page, r.end_page) for r in spans.section_spans(starts, counts).collect()) == [("A", 2, 4), ("B", 5, 9)]


def test_subsections_touch(spark):
    sections = spark.createDataFrame([("d", "A", 5, 12)], "doc_id string, section string, start_page int, end_page int")
    items = spark.createDataFrame([("d", 1, 5, "x", "A.1"), ("d", 2, 9, "y", "a.2")], "doc_id string, seq int, page int, title string, left_marker string")
    assert sorted((r.code, r.start_page, r.end_page) for r in spans.subsection_spans(items, sections).collect()) == [("A.1", 5, 9), ("A.2", 9, 12)]


def test_printed_pages_are_shifted_and_clamped(spark):
    s = spark.createDataFrame([("d", 2, 3), ("d", 7, 8), ("d", 11, 30)], "doc_id string, start_page int, end_page int")
    o = spark.createDataFrame([("d", 3, 12)], "doc_id string, offset_arabic int, page_count int")
    assert sorted((r.pdf_start, r.pdf_end) for r in pageoffset.resolve_pages(s, o).collect()) == [(5, 6), (10, 11), (12, 12)]


def test_report_texts(spark):
    assert one(spark, report.value_de(F.col("v"), F.col("u")), v=1234.0, u="EUR") == "1.234,00 EUR"
    assert one(spark, report.value_compact(F.col("v"), F.col("u")), v=2.5e9, u="EUR") == "2,50 Mrd €"
    assert one(spark, report.hint(F.col("s"), F.col("n")), s="extracted", n="note") == "Automatisch extrahiert – note"
    assert one(spark, report.hint(F.col("s"), F.col("n")), s="manual", n="note") == "note"


def test_override_without_value_removes_ratio(spark):
    ext = spark.createDataFrame([("d", "eof_total", 200.0, "EUR", True), ("d", "scr_total", 100.0, "EUR", True), ("e", "eof_total", 3.0, "EUR", True), ("e", "scr_total", 2.0, "EUR", True)], "doc_id string, field_id string, value double, unit string, verified boolean")
    over = spark.createDataFrame([("d", "scr_total", None, "EUR", "n"), ("gone", "scr_total", 1.0, "EUR", "n")], "doc_id string, field_id string, value double, unit string, note string")
    got = {(r.doc_id, r.field_id): (r.value, r.source_type) for r in merge.final_values(ext, over, spark.createDataFrame([("d",), ("e",)], "doc_id string")).collect()}
    assert got == {("d", "eof_total"): (200.0, "extracted"), ("d", "scr_total"): (None, "manual"), ("e", "eof_total"): (3.0, "extracted"), ("e", "scr_total"): (2.0, "extracted"), ("e", "sii_ratio_pct"): (150.0, "derived")}


def test_responses(spark):
    raw = [("ok", '{"status":"ok","value_unscaled":1,"scale":1000,"unit":"EUR","source_text":" a  b ","other":1}'), ("blank", "  "), ("bad", "{x"), ("scale", '{"status":"ok","value_unscaled":1,"scale":100}')]
    df = spark.createDataFrame([(k, r, "scr_total", 4) for k, r in raw], "k string, raw string, field_id string, start_page int")
    got = {r.k: r for r in extract.parse_responses(df).collect()}
    assert (got["ok"].status, got["ok"].source_text, got["ok"].scale, len(got["ok"].snippet_hash)) == ("ok", "a b", 1000.0, 16)
    assert (got["blank"].status, got["blank"].has_evidence, got["blank"].error) == ("not_found", False, None)
    assert got["bad"].error == "invalid response" and got["scale"].error == "scale not allowed"


def test_summaries_fall_back_to_chunks(spark):
    s = spark.createDataFrame([("d", "A", "x" * 50), ("d", "B", " ")], "doc_id string, section_id string, text string")

    def answer(p):
        short = F.length("prompt") < 80
        return p.withColumn("raw", F.when(short, F.concat(F.lit("s"), F.length("prompt").cast("string"))).otherwise("")).withColumn("truncated", ~short)

    got = {r.section_id: r.summary for r in extract.summarise(s, answer, size=20, overlap=5).collect()}
    assert got["B"] == extract.NOTHING_RELEVANT and got["A"].startswith("s")


def test_replay_provider(spark):
    p = spark.createDataFrame([("hello",), ("other",)], "prompt string")
    known = p.limit(1).select(extract.request_hash(F.col("prompt"), "m").alias("request_hash"), F.lit("hi").alias("raw"), F.lit(None).cast("string").alias("incomplete_reason"))
    got = {r.prompt: r.raw for r in extract.provider("replay", responses=known, model="m")(p).collect()}
    assert got == {"hello": "hi", "other": None}
    with pytest.raises(ValueError):
        extract.provider("none")


def test_report_lines(spark):
    g = spark.createDataFrame([("d", "f", "EUR", 1.0)], "doc_id string, field_id string, unit string, value double")
    p = spark.createDataFrame([("d", "f", "EUR", 400.0, True)], "doc_id string, field_id string, unit string, value double, verified boolean")
    lines = evaluate.report(g, p).head().report.split("\n")
    assert len(lines) == 9 and lines[3] == "Within tolerance (all): 1 / 1  (accuracy=100.0%)" and lines[7] == "Unverified but OK     : 0"
    none = evaluate.report(g.where("false"), p).head().report
    assert "Recall (verified corr): 0.0%" in none
    off = p.withColumns({"value": F.lit(9000.5), "verified": F.lit(False)})
    assert evaluate.errors(g, off).head().message == "WRONG d/f pred=9000.5 EUR gold=1.0 EUR"


def test_ratio_note(spark):
    x = spark.createDataFrame([("ok", 150.0, "%", 120.0, 5.0), ("ok", 150.0, "%", 152.0, 5.0)], "status string, value_unscaled double, unit string, ratio_expected double, ratio_tol double")
    x = x.selectExpr("*", "cast(null as double) scale", "cast(null as double) typical_scale", "cast(null as string) source_text", "cast(null as string) page_text", "true has_evidence")
    got = verify.verify(x).collect()
    assert [(r.verifier_notes, r.confidence) for r in got] == [("Erwartetes Verhältnis ist 120.0 anstatt 150.0", 0.6), (None, 0.75)]


def test_hyphenation_over_whole_documents(spark, sf):
    import re

    from ledgerlens.plans import catalogue

    def joined(t):
        t = re.sub(r"(?<=\w)\s+(?=\w+[ \t]*-\s*\r?\n\s*\w)", "", t)
        t = re.sub(r"(?<=\w)\s*-\s*\r?\n\s*(?=\w)", "", t)
        t = re.sub(r"(?<=[A-Za-zÄÖÜäöüß])\r?\n(?=[a-zäöüß])", "", t)
        return re.sub(r"[ \t]{2,}", " ", t)

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalogue.queries()["normalize_hyphenation_full"](spark, sf).collect()}
    assert got == {i: None if t is None else joined(t.replace("th", "t-\n h")) for i, t in texts.items()}


def test_contents_items_by_brute_force(spark):
    import random

    r = random.Random(51)
    words = ["A.", "B.1", "C", ".", "Teil D", "Titel", "Thema ..... 7", "12", "…", "E. Kapital", "3", "A.2.1 Rest", "Anhang 40"]
    placed = [("d", p, n, r.choice(words), float(r.randrange(500)), float(r.randrange(0, 60)) + 0.25) for p in range(3) for n in range(60)]
    table = spark.createDataFrame(placed, "doc_id string, page_index int, span_seq int, text string, x0 double, y0 double")
    want, seen = [], set()
    for p in range(3):
        rows, level = [], None
        for _, _, seq, text, x, y in sorted((s for s in placed if s[1] == p), key=lambda s: (round(s[5]), s[4], s[2])):
            if level is None or abs(y - level) > toc.TOLERANCE:
                rows.append([])
                level = y
            else:
                level = (level + y) / 2
            rows[-1].append((x, text))
        for k, row in enumerate(rows):
            item = toc.parse_item([t for _, t in sorted(row, key=lambda s: s[0])])
            if item and (item[2], item[0].lower(), item[1].lower()) not in seen:
                seen.add((item[2], item[0].lower(), item[1].lower()))
                want.append((p * 10000 + k, item[2], item[0], item[1]))
    got = [(x.seq, x.page, x.title, x.left_marker) for x in toc.items(toc.lines(table)).collect()]
    assert len(want) > 5 and sorted(got) == sorted(want)


def test_pages_in_span_of_odd_spans_and_pages(spark):
    table = [("d", 1, "one"), ("d", 1, "again"), ("d", 3, None), ("d", 10**9, "last"), ("d", None, "x"), ("e", 2, "two"), ("e", 0, "nought"), (None, 1, "y")]
    asked = [("d", 1, -5, 2**31 - 1), ("d", 2, 2, 2), ("d", 3, 3, 3), ("d", 4, 2, 1), ("d", 5, 1, None), ("d", 6, None, 3), ("e", 1, 1, 2), ("e", 2, 1, 2), ("f", 1, 1, 2), (None, 1, 1, 1)]
    asked += [("e", 9, 2, 2), ("e", 9, 1, 5)]  # rows of one span
    s, p = spark.createDataFrame(asked, "doc_id string, span_id int, start_page int, end_page int"), spark.createDataFrame(table, "doc_id string, page int, text string")
    want = {}
    for doc, span, start, end in asked:
        hits = want.setdefault((doc, span), [])
        hits += [(page, text or "") for d, page, text in table if doc and d == doc and end is not None and page is not None and max(1, start or 1) <= page <= end]
    want = sorted((repr(k), "\n".join(t for _, t in sorted(v) if t), len(v)) for k, v in want.items())
    for texts in (None, lambda w: p.join(w, ["doc_id", "page"])):
        got = [(repr((r.doc_id, r.span_id)), r.text, r.n_pages) for r in spans.pages_in_span(s, p, texts=texts).collect()]
        assert sorted(got) == want


def test_pages_in_span_compares_no_pairs(spark):
    """All spans of a document against all of its pages would be pairs; joins are by equal keys alone."""
    s = spark.range(4000).selectExpr("id % 2 AS doc_id", "id AS span_id", "CAST(id % 7 AS INT) AS start_page", "CAST(id % 7 + 2 AS INT) AS end_page")
    p = spark.range(4000).selectExpr("id % 2 AS doc_id", "CAST(id / 2 AS INT) AS page", "'t' AS text")
    df = spans.pages_in_span(s, p)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)
    assert df.agg(F.sum("n_pages")).head()[0] == sum(i % 7 + 2 - max(1, i % 7) + 1 for i in range(4000))
