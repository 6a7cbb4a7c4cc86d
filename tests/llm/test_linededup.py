from geoloom.llm import linededup

NOISE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(k):
    return " ".join(NOISE[(k * (j + 3) + j * j + k // 12) % 12] + "abcdefghijklmnop"[(k + j) % 16] for j in range(8 + k % 3)) + f" end{chr(97 + k % 26)}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "kept", 3) for i, t in rows], "doc_id long, text string, lang string, k int")


def result(df):
    return {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"]) for r in linededup.drop_repeated_lines(df).collect()}


def test_exact_and_variable_lines(spark):
    rows = []
    for i in range(8):
        lines = [prose(i), "All rights reserved.", f"Page {i} of 20 in total"]
        if i >= 2:
            lines.append(f"Posted here by user {NOISE[i]} on a Monday morning")
        if i == 5:
            lines += [prose(100), "ok go", "ok go"]
        rows.append((i, "\n".join(lines)))
    got = result(frame(spark, rows))
    assert got[0][0].split("\n") == [prose(0), "All rights reserved.", "Page 0 of 20 in total"]
    assert got[2][0].split("\n") == [prose(2), f"Posted here by user {NOISE[2]} on a Monday morning"]
    assert got[5][0].split("\n") == [prose(5), prose(100), "ok go", "ok go"] and got[5][1:] == (7, 3)
    assert all(got[i][0] == prose(i) for i in (1, 3, 4, 6, 7))


def test_a_shared_start_is_no_template(spark):
    rows = [(i, f"It was then {prose(i)[:40].strip()} and {prose(i + 31)[:30].strip()}") for i in range(12)]
    got = result(frame(spark, rows))
    assert {i: t for i, t in rows} == {i: v[0] for i, v in got.items()}


def test_nulls_repeats_long_texts_and_few_documents(spark):
    long = "\n".join(prose(1000 + k) + f" {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}z" for k in range(3000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, "the same line here\nthe same line here"), (6, "the same line here"), (None, "the same line here"), (6, "the same line here"), (7, "the same line here"), (8, "the same line here")]
    df = frame(spark, rows)
    out = linededup.drop_repeated_lines(df).collect()
    assert len(out) == len(rows) and out[0].lang == "kept"
    texts = sorted((str(r.doc_id), r.text) for r in out)
    want = [(i, t) for i, t in rows if i in (1, 2, 3, 4)] + [(5, ""), (6, ""), (6, ""), (7, ""), (8, ""), (None, "the same line here")]
    assert texts == sorted((str(i), t) for i, t in want)
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0
    four = frame(spark, [(i, "the same line here") for i in range(4)])
    assert all(r.text for r in linededup.drop_repeated_lines(four).collect())


def test_columns_named_like_the_counts(spark):
    rows = [(i, "the same line here\n" + prose(i), "a", "b") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __n_lines string, __n_dropped string")
    out = linededup.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "__n_lines", "__n_dropped", "__n_lines_", "__n_dropped_"]
    assert all((r["__n_lines"], r["__n_lines_"], r["__n_dropped_"]) == ("a", 2, int(r.doc_id > 0)) for r in out.collect())
