from clickloom.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0."
MIT = "Released under the MIT License."


def scanned(spark, *files):
    frame = spark.createDataFrame(list(files), "path string, text string")
    return {r.path: (r.licence, r.how, r.from_path) for r in licenses.scan(frame).collect()}


def test_every_template_is_found_as_itself(spark):
    files = [(f"f{i}", f"Some prose.\n# {body}\nMore prose.") for i, (_, body) in enumerate(licenses.TEMPLATES)]
    found = scanned(spark, *files)
    assert [found[f"f{i}"][0] for i in range(len(files))] == [n for n, _ in licenses.TEMPLATES]


def test_nearest_folder_wins_and_own_notice_before_it(spark):
    found = scanned(
        spark,
        ("LICENSE", MIT),
        ("a/COPYING.txt", APACHE),
        ("a/b/c/x.py", "print()"),
        ("a/b/own.py", "code\n# This work is licensed under the GNU General Public License, version 3.\n"),
        ("d/e/y.py", "print()"),
        ("ab/z.py", "print()"),
        ("a/b/LICENSE", "nothing of the kind"),
    )
    assert found["a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/COPYING.txt")
    assert found["a/b/own.py"] == ("GPL-3.0", "own", "a/b/own.py")
    assert found["d/e/y.py"] == ("MIT", "inherited", "LICENSE")
    assert found["ab/z.py"] == ("MIT", "inherited", "LICENSE")
    assert found["a/b/LICENSE"] == ("Apache-2.0", "inherited", "a/COPYING.txt")


def test_prose_with_single_words_is_no_notice(spark):
    found = scanned(
        spark,
        ("x/1", "The general public may use the apache helicopter by license of the crown."),
        ("x/2", "mit mit mit by by version 3 of a long story about nothing in particular at all"),
        ("x/3", "free"),
    )
    assert {how for _, how, _ in found.values()} == {"none"}


def test_whole_licence_files_are_compared(spark):
    body = licenses.TEMPLATES[15][1]
    half = body.index("copy of")
    found = scanned(spark, ("p/LICENSE.md", body[:half] + "\n" + body[half:]), ("p/q", "x"))
    assert found["p/LICENSE.md"][:2] == ("MIT", "own")
    assert found["p/q"] == ("MIT", "inherited", "p/LICENSE.md")


def test_ties_go_to_score_and_then_to_names(spark):
    found = scanned(spark, ("t/NOTICE", MIT), ("t/COPYING", APACHE), ("t/f", None))
    assert found["t/f"] == ("Apache-2.0", "inherited", "t/COPYING")


def test_odd_rows_extra_columns_and_empty_tables(spark, tricky):
    files = tricky.selectExpr("* except (path)", "concat('d/', doc_id) as path")
    found = licenses.scan(files).collect()
    assert len(found) == files.select("path").distinct().count()
    assert {r.how for r in found} == {"none"} and "" in {r.path for r in found}
    assert licenses.scan(files.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([("a", MIT)], "path string, text string")
    plan = licenses.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
