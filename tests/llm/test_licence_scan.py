from tallyloom.llm import licence_scan as S

MIT, APACHE = "Released under the MIT License.", "// Licensed under the Apache License, Version 2.0"


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, licence string")


def test_own_licences_and_nearest_directory(spark):
    rows = [
        ("LICENSE", MIT, ""), ("a/x.py", "import os", ""), ("a/b/COPYING.txt", APACHE, ""), ("a/b/y.py", None, ""), ("a/b/c/z.py", "", ""),
        ("a/b/w.py", f"# head\n{MIT}\ncode", ""), ("a/b/w.py", f"# head\n{MIT}\ncode", ""), (None, MIT, ""), ("d/licensed.py", "the licensed version of a work under licence", ""),
        ("e/notes.md", f"{APACHE}\n{MIT}", ""), ("f/long.txt", "word " * 50_000 + "\n" + MIT, ""),
    ]
    got = sorted(tuple(r) for r in S.licences(files(spark, rows)).select("path", "licence", "basis", "source").collect())
    assert got == sorted([
        ("LICENSE", "MIT", "own", "LICENSE"), ("a/x.py", "MIT", "inherited", "LICENSE"), ("a/b/COPYING.txt", "Apache-2.0", "own", "a/b/COPYING.txt"),
        ("a/b/y.py", "Apache-2.0", "inherited", "a/b/COPYING.txt"), ("a/b/c/z.py", "Apache-2.0", "inherited", "a/b/COPYING.txt"),
        ("a/b/w.py", "MIT", "own", "a/b/w.py"), ("a/b/w.py", "MIT", "own", "a/b/w.py"), ("d/licensed.py", "MIT", "inherited", "LICENSE"),
        ("e/notes.md", "Apache-2.0", "own", "e/notes.md"), ("f/long.txt", "MIT", "own", "f/long.txt"),
    ])


def test_no_licence_and_no_rows(spark):
    assert [tuple(r)[1:3] for r in S.licences(files(spark, [("a/x", "text", "")])).collect()] == [(None, "none")]
    assert S.licences(files(spark, [("a", "", "")]).limit(0)).count() == 0


def test_words_that_are_left_out_cannot_reach_the_threshold():
    vectors = [(0, "A", "rare", 0.9), (0, "A", "mid", 0.4), (0, "A", "the", 0.17)]
    assert S._needed(vectors, 0.8) == ["rare"]
    assert S._needed(vectors, 0.3) == ["mid", "rare"]
