import re

from tallyloom.llm import line_dedup as L

LONG = " ".join(f"word{i}" for i in range(30))
PLAIN = {"line": r"[^\n]+", "sentence": r"[^\n.!?]*[.!?]+|[^\n.!?]+"}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def plain(texts, unit, least):
    """By definition, document by document."""
    first, out = {}, []
    for i in sorted(texts):
        if unit == "paragraph":
            cut, at = [], 0
            for part in texts[i].split("\n\n"):
                cut.append((at, at + len(part), part))
                at += len(part) + 2
        else:
            cut = [(m.start(), m.end(), m[0]) for m in re.finditer(PLAIN[unit], texts[i])]
        run = []
        for start, end, text in [*((s, e, t.lower().split()) for s, e, t in cut if t.strip()), (None, None, None)]:
            key = text and " ".join(text)
            kept = first.setdefault(key, (i, start)) if key else (i, start)
            if key and kept != (i, start):
                run.append((i, start, end, len(text), *kept))
            else:
                words = sum(r[3] for r in run)
                out += [(*r, words) for r in run if words >= least]
                run = []
    return sorted(out)


def test_first_occurrence_stays_and_offsets_are_of_the_original(spark):
    frame = docs(spark, [(1, f"short\n{LONG}\nend", "x"), (2, f"é😀\n{LONG.upper()}  \n{LONG}", "x"), (3, "short\nend", "x"), (4, None, "x"), (5, "", "x"), (None, LONG, "x")])
    gone = sorted(tuple(r) for r in L.removals(frame, "line").collect())
    n = len(LONG)
    assert gone == [(2, 3, 5 + n, 30, 1, 6, 60), (2, 6 + n, 6 + 2 * n, 30, 1, 6, 60)]
    out = {r.doc_id: r for r in L.without(frame, L.removals(frame, "line")).collect()}
    assert out[1].text == f"short\n{LONG}\nend" and out[2].text == "é😀\n" and out[3].text == "short\nend" and out[4].text is None
    assert [(s.start, s.end) for s in out[2].removed_spans] == [g[1:3] for g in gone] and out[2].digest == "x" and out[None].text == LONG


def test_all_units_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts[-1], texts[-2] = "A b. C d!\n\nE f?? g\n\n\n\nA b. c", "A b.\n\nE f?? g\n\nE  F?? g"
    frame = docs(spark, [(i, t, "") for i, t in texts.items()])
    for unit, least in (("sentence", L.LEAST_RUN), ("sentence", 0), ("line", 0), ("paragraph", 0)):
        got = sorted(tuple(r) for r in L.removals(frame, unit, least).collect())
        assert got == plain(texts, unit, least) and got


def test_passage_inside_longer_lines_goes(spark):
    passage = " ".join(f"Some words of part {i} repeat." for i in range(10))
    frame = docs(spark, [(1, f"One begins so {passage} And goes on.", "x"), (2, f"Another line. It has {passage} Then ends.\nLast line.", "x")])
    out = {r.doc_id: r.text for r in L.without(frame, L.removals(frame)).collect()}
    assert out[1].endswith("goes on.") and out[2] == "Another line. It has Some words of part 0 repeat. Then ends.\nLast line."


def test_columns_with_clashing_names_stay(spark):
    frame = docs(spark, [(1, LONG, "x"), (2, LONG, "y")]).selectExpr("*", "7 as removed_spans", "8 as run", "9 as start")
    out = {r.doc_id: r for r in L.without(frame, L.removals(frame)).collect()}
    assert (out[2].text, out[2].removed_spans, out[2].run, out[2].start) == ("", 7, 8, 9) and len(out[2].removed_spans_1) == 1


def test_hot_line_paragraphs_ties_and_empty_tables(spark):
    frame = docs(spark, [(i % 300, f"{LONG}\n\nown {i % 300} " + "y " * 3, "x") for i in range(600)])
    gone = L.removals(frame).collect()
    assert len(gone) == 299 and {(r.kept_doc_id, r.kept_start) for r in gone} == {(0, 0)}  # repeated rows are one document
    assert L.removals(frame, "paragraph").count() == 299
    assert L.removals(frame.limit(0)).count() == 0 and L.without(frame.limit(0), L.removals(frame)).count() == 0


def test_very_long_text(spark):
    frame = docs(spark, [(1, "\n".join([LONG] * 3000), "x"), (2, "z" * 500_000, "x")])
    assert L.removals(frame).count() == 2999
