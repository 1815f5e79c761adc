"""Small cases whose results are known by hand."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sheetloom.functions import text as T
from sheetloom.operators import access, approvals, columns, edits, grid, healing, matching, scan
from sheetloom.operators import rows as O
from sheetloom.sources import exports, readers, recognise
from sheetloom.streaming import intake


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("numeric", "l0O,5", "1005"), ("numeric", "[B12.|", "812"), ("numeric", "abc", "abc"), ("numeric", "-5", "5"),
        ("name", "o'BRIEN mary-JANE", "O'Brien Mary-Jane"), ("name", "a|da", "Aida"), ("name", "ada - lovelace", "Ada Lovelace"), ("name", "éric josé", "éRic José"),
        ("status", "present", "P"), ("status", "half", "HD"), ("status", "h", "H"), ("status", "Sunday", "S"), ("status", "xyz", "XYZ"),
        ("serial", "l.", "1"), ("serial", "abc", ""), ("name", " \t  ", ""), ("numeric", None, ""), ("text", "|a|b|", "aIb"),
    ],
)
def test_cells(spark, kind, raw, want):
    assert value(spark, T.clean_cell(F.lit(raw).cast("string"), F.lit(kind))) == want


def test_character_rules(spark):
    got = [value(spark, T.apply_character_rules(F.lit(x))) for x in ("O 5", "S5 5S B7", "l 9", "a || b", " |[ ", "x—y")]
    assert got == ["0 5", "55 55 87", "1 9", "a  b", "", "x-y"]


def plain_rules(x):
    word = lambda i: 0 <= i < len(x) and (x[i].isascii() and (x[i].isalnum() or x[i] == "_"))
    edge = lambda i: word(i - 1) != word(i)
    digit = lambda i: 0 <= i < len(x) and x[i] in "0123456789"
    space = " \t\n\x0b\f\r"

    def digit_after(i):
        while i < len(x) and x[i] in space:
            i += 1
        return digit(i)

    def digit_before(i):
        while i > 0 and x[i - 1] in space:
            i -= 1
        return digit(i - 1)

    def put(holds, to):
        return "".join(to if holds(i) else c for i, c in enumerate(x))

    alone = lambda i: edge(i) and edge(i + 1)
    for holds, to in (
        (lambda i: x[i] == "O" and alone(i) and digit_after(i + 1), "0"), (lambda i: x[i] == "O" and edge(i + 1) and digit_before(i), "0"), (lambda i: x[i] in "lL" and alone(i) and digit_after(i + 1), "1"),
        (lambda i: x[i] == "S" and edge(i) and digit(i + 1), "5"), (lambda i: x[i] == "S" and edge(i + 1) and digit(i - 1), "5"), (lambda i: x[i] == "B" and edge(i) and digit(i + 1), "8"),
        (lambda i: x[i] == "B" and edge(i + 1) and digit(i - 1), "8"), (lambda i: x[i] == "l" and alone(i), "1"), (lambda i: x[i] == "|" and digit_after(i + 1), "1"),
    ):
        x = put(holds, to)
    x, out, i = x.replace("—", "-"), "", 0
    while i < len(x):
        n = len(x[i:]) - len(x[i:].lstrip("|"))
        out, i = (out + "|" * (n == 1), i + n) if n else (out + x[i], i + 1)
    return "" if out and not out.strip(space + "|[].") else out


def test_character_rules_against_plain_ones(spark):
    import random

    r = random.Random(50)
    texts = ["".join(r.choice("OlLSB||0179 a—[]._\t") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    texts += [f"{r.choice('5a')}{' ' * n}{r.choice(('O', 'O O', 'l', 'S'))}" for n in range(40)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.apply_character_rules("t").alias("c")).collect()
    wrong = [(texts[g["i"]], g["c"], plain_rules(texts[g["i"]])) for g in got if g["c"] != plain_rules(texts[g["i"]])]
    assert not wrong, wrong[:5]


def test_rounding_and_display(spark):
    assert value(spark, T.round_half_up(F.lit(-0.5))) == 0
    assert value(spark, T.display(F.lit(""))) == "-"
    assert value(spark, T.cut(F.lit("abcdefghijklmn"))) == "abcdefghijkl…"


def rows_of(spark, cells, **more):
    return spark.createDataFrame([Row(doc_id=1, row_idx=i, columns=c, text="  ".join(c), is_header=False, confidence=80.0, bbox=Row(y0=i * 15.0, y1=i * 15.0 + 10)) for i, c in enumerate(cells)])


def test_validate_row(spark):
    got = O.validate_row(rows_of(spark, [["Ada", "x", "y", "z"], ["a"]]), F.lit(3)).orderBy("row_idx").collect()
    assert got[0]["corrected"] == ["Ada", "x", "y z"] and len(got[0]["issues"]) == 1 and not got[0]["is_valid"]
    assert got[1]["corrected"] == ["a", "", ""] and len(got[1]["issues"]) == 2


def test_validate_documents(spark):
    got = O.validate_documents(rows_of(spark, [["a"] * n for n in (3, 3, 2, 2)])).first()
    assert (got["dominant"], got["outliers"], got["consistent"], got["quality"]) == (2, [0, 1], False, "low")


@pytest.mark.parametrize(
    ("at", "n", "cells", "region", "confidence"),
    [(0, 1, ["Attendance Register 2024"], "title", 90), (6, 7, ["Prepared by Ada"], "metadata", 80), (0, 1, ["Sunday", "x", "y"], "header", 90), (9, 10, ["Grand Total 10", "x", "y"], "footer", 80), (1, 2, ["", " "], "empty", 99)],
)
def test_classify(spark, at, n, cells, region, confidence):
    got = O.classify(rows_of(spark, [["q", "q", "q"]] * at + [cells] + [["q", "q", "q"]] * (n - at - 1))).filter(F.col("row_idx") == at).first()
    assert (got["region"], got["region_confidence"]) == (region, confidence)


def test_merge_headers(spark):
    rows = O.classify(rows_of(spark, [["Total Working", "x", "q"], ["Days Present", "", "q"], ["1", "2", "3"]]))
    got = O.merge_headers(rows).orderBy("row_idx").collect()
    assert [r["columns"] for r in got] == [["Total Working Days Present", "x", "q q"], ["1", "2", "3"]]
    assert got[0]["explanation"] == O.MERGED and got[1]["explanation"] == O.DATA


def test_kinds(spark):
    labels = ["Working Days", "Notes", "Present", "%", "Role", "Balance", "City"]
    got = [value(spark, columns.by_label(F.lit(x), columns.LABELS)) for x in labels]
    assert got == ["date", "serial", "status", "percentage", "designation", "numeric", None]
    assert value(spark, columns.by_label(F.lit("Present"), columns.WORKSPACE_LABELS)) == "numeric"


MEMBERS = "member_ord int, id string, full_name string, aliases array<string>"
CORRECTIONS = "ord int, incorrect_text string, corrected_member_id string"


@pytest.mark.parametrize("hint", [None, "shuffle_hash"])
def test_delete_cascade_of_ids_twice_and_null(spark, hint):
    """Ids given twice, null ids and keys, and rows of a parent that is not there: a null meets nothing."""
    parents = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "a"), (6, "d")], "k int, parent string")
    gone = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "id string")
    left, children = approvals.delete_cascade(parents, gone.hint(hint) if hint else gone, {"rows": (rows, "parent")})
    assert sorted(r["n"] for r in left.collect()) == [2, 3]
    assert sorted(r["k"] for r in children["rows"].collect()) == [2, 3, 6]


def test_cascade(spark):
    members = spark.createDataFrame([(1, "m1", "Ada Lovelace", ["Ada"]), (2, "m2", "Grace Hopper", []), (3, "m3", "Grace Hopper", None)], MEMBERS)
    corrections = spark.createDataFrame([(1, "Adaa", "m1"), (2, "AB", "m1"), (3, "ab", "m2"), (4, "gone", "m9")], CORRECTIONS)
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Adaa", "Ab", "ADA", "grace hopper", "Lovelase", "gone", "", None, "qqqq"])], "row_idx int, ocr_name string")
    got = {r["ocr_name"]: (r["member_id"], r["status"]) for r in matching.cascade(names, members, corrections).collect()}
    assert got == {
        "Adaa": ("m1", "correction"), "Ab": ("m2", "correction"), "ADA": ("m1", "exact"), "grace hopper": ("m2", "exact"), "Lovelase": ("m1", "fuzzy"),
        "gone": (None, "none"), "": ("m1", "exact"), None: (None, "none"), "qqqq": (None, "none"),
    }
    nobody = matching.cascade(names, members.limit(0), corrections)
    assert nobody.filter("status <> 'none'").count() == 0 and nobody.count() == 9


def test_edits_within(spark):
    got = [value(spark, matching.edits_within(F.lit(p), F.lit(x))) for p, x in (("lovelase", "ada lovelace"), ("ada", "ada lovelace"), ("abc", ""), ("xyz", "ayz"))]
    assert got == [1, 0, 3, 1]


def near(p, x):
    """Least edits to any part of x."""
    row = [0] * (len(x) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(x, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edits_by_bits_equal_the_table(spark):
    import random

    r = random.Random(5)
    word = lambda low, high, some: "".join(r.choice(some) for _ in range(r.randint(low, high)))
    pairs = [(word(1, 62, some), word(0, 80, some)) for some in ("ab", "abcdé ", "abcdefghijklmnop") for _ in range(150)] + [("a" * 62, "a" * 80), ("ab" * 31, "ba" * 40)]
    df = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(pairs)], "i int, p string, x string")
    got = df.select("i", matching.edits_by_bits(matching.masks(F.col("p")), F.length("p"), F.col("x")).alias("e")).collect()
    assert [e for _, e in sorted(got)] == [near(p, x) for p, x in pairs]


def plain_fuzzy(texts, members):
    """The member of the least product of weighted scores; ties by the whole distance, then the roster."""

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    out = {}
    for t in texts:
        found = []
        for order, member, name, aliases in members:
            reach = [[near(t, x) for x in key if near(t, x) <= 0.35 * len(t)] for key in ([name], aliases or [])]
            if any(reach):
                score = 1.0
                for weight, own in zip((0.7, 0.3), reach, strict=True):
                    score *= max(min(own) / len(t), 2.0**-52) ** weight if own else 1.0
                found.append((round(score, 12), whole(t, name), order, member))
        if found:
            out[t] = (min(found)[3], min(found)[0])
    return out


def test_fuzzy_blocking_loses_nothing(spark):
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    members = [(i, f"m{i}", word(r.randint(1, 9)), [word(r.randint(0, 7)) for _ in range(r.randint(0, 2))]) for i in range(40)] + [(40, "m40", word(70), None)]
    texts = sorted({word(r.randint(1, 8)) for _ in range(60)} | {members[40][2][:66] + "a", "é", "éab"})
    got = {x["t"]: (x["member_id"], round(x["score"], 12)) for x in matching.fuzzy(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(members, MEMBERS)).collect()}
    assert got == plain_fuzzy(texts, members)


def test_boundaries_and_components(spark):
    profile = spark.createDataFrame([(1, i, float(v), 11) for i, v in enumerate([0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1])], "img_id int, at int, share float, size int")
    assert sorted(r["at"] for r in grid.boundaries(profile, 0.015, 3).collect()) == [0, 2, 8, 10]
    ink = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 0, 1, 1], [1, 1, 0, 0]], bool)
    assert grid.components_of(ink) == [(0, 0, 1, 2, 2), (2, 0, 2, 3, 5), (0, 3, 2, 1, 2)]
    spiral = np.ones((9, 9), bool)
    spiral[1, :8] = spiral[3, 1:] = spiral[5, :8] = spiral[7, 1:] = False
    assert grid.components_of(spiral) == [(0, 0, 9, 9, int(spiral.sum()))]


def test_approvals(spark):
    rows = spark.createDataFrame([("s", 1, "m1", "true", None), ("s", 2, "m1", "false", None), ("s", 3, None, None, None), ("s", 4, "m1", None, False)], "session_id string, row_idx int, member_id string, is_header string, present boolean")
    sessions = spark.createDataFrame([("s", 7, "e", "pending")], "id string, owner_id int, event_name string, status string").withColumns({"session_date": F.lit("2024-01-01").cast("date"), "updated_at": F.lit(None).cast("date")})
    strict = approvals.attendance_of(rows, sessions).collect()
    assert [(r["member_id"], r["present"]) for r in strict] == [("m1", False)]
    assert approvals.attendance_of(rows, sessions, strict=False).count() == 2
    once = approvals.upsert(approvals.attendance_of(rows, sessions).limit(0), approvals.attendance_of(rows, sessions), ["session_id", "member_id"])
    assert approvals.upsert(once, approvals.attendance_of(rows, sessions), ["session_id", "member_id"]).count() == 1


def test_approve_in_one_plan(spark):
    """final_table and suggested_table are set; JSON null is told from a missing member; wrong sessions raise in the plan."""
    table = '[{"isHeader":true,"suggestedMember":{"id":"m9"}},{"present":false,"suggestedMember":{"id":"m1"}},{"suggestedMember":null},{"x":1},{"suggestedMember":{"id":"m2"},"isHeader":"true"},{"suggestedMember":{"id":"m3"}}]'
    sessions = spark.createDataFrame([("s", 7, "e", "pending"), ("t", 8, "f", "pending")], "id string, owner_id int, event_name string, status string").withColumns({"session_date": F.lit("2024-01-01").cast("date"), "updated_at": F.lit(None).cast("date")})
    asked = lambda session, text: spark.createDataFrame([(session, text)], "session_id string, t string").select("session_id", F.parse_json("t").alias("rows"))
    before = spark.createDataFrame([("s", "m1", "old", True), ("t", "m1", "old", True)], "session_id string, member_id string, event_name string, present boolean").withColumn("attendance_date", F.lit("2000-01-01").cast("date"))
    at = F.lit("2024-02-02").cast("date")
    done, facts = approvals.approve(sessions, asked("s", table), before, 7, at)
    shown = {r["id"]: tuple(r)[1:] for r in done.select("id", "status", F.col("updated_at").isNotNull(), F.to_json("final_table").isNotNull(), F.to_json("suggested_table").eqNullSafe(F.to_json("final_table"))).collect()}
    assert shown == {"s": ("approved", True, True, True), "t": ("pending", False, False, True)}
    assert sorted((r["session_id"], r["member_id"], r["present"]) for r in facts.collect()) == [("s", "m1", False), ("s", "m3", True), ("t", "m1", True)]
    _, compat = approvals.approve(sessions, asked("s", table), before, 7, at, strict=False)
    assert sorted(str(r["member_id"]) for r in compat.filter("session_id = 's'").collect()) == ["None", "m1", "m3"]
    twice = asked("s", '[{"suggestedMember":{"id":"m1"}},{"suggestedMember":{"id":"m1"}}]')
    assert approvals.approve(sessions, twice, before, 7, at)[1].filter("session_id = 's'").count() == 1
    for bad, strict in ((asked("t", "[]"), True), (asked("gone", table), True), (twice, False)):
        out = approvals.approve(sessions, bad, before, 7, at, strict)
        with pytest.raises(Exception, match="not found or not owned|two rows of member"):
            [df.collect() for df in out]
    assert approvals.approve(sessions, asked("s", "[]"), before, 7, at)[1].count() == 2


def test_names_in_the_order_of_a_collation(spark):
    names = ["Zoë", "ábel", "Abel", "abel", "Éva", "Eva", "zoe", None, "Adam"]
    got = access.numbered(access.by_name(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, full_name string"))).orderBy("ordinal").collect()
    assert [g["full_name"] for g in got] == ["abel", "Abel", "ábel", "Adam", "Eva", "Éva", "zoe", "Zoë", None] and [g["ordinal"] for g in got] == list(range(1, 10))


def test_large_files_are_rejected_unread(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "b.jpg").write_bytes(b"hello")
    for name in ("c.jpg", "d.bin"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30)
    taken, rejected = readers.admit_images(spark, str(tmp_path))
    assert [(r["kind"], bytes(r["content"])[8:]) for r in taken.collect()] == [("image/png", b"x")]
    assert {r["path"][-5:]: r["reason"] for r in rejected.collect()} == {"b.jpg": readers.NO_IMAGE, "c.jpg": readers.TOO_LARGE, "d.bin": readers.NO_IMAGE}
    assert "LessThanOrEqual(length,10485760)" in taken._jdf.queryExecution().toString()


def test_distances_of_time(spark):
    now = "2024-06-15 12:00:00"
    cases = {"2024-06-15 12:00:00": "less than a minute ago", "2024-06-15 11:59:30": "1 minute ago", "2024-06-15 12:03:00": "in 3 minutes", "2024-06-15 11:15:00": "about 1 hour ago", "2024-06-14 13:00:00": "about 23 hours ago",
             "2024-06-14 11:00:00": "1 day ago", "2024-06-01 12:00:00": "14 days ago", "2024-05-10 12:00:00": "about 1 month ago", "2024-02-15 12:00:00": "4 months ago", "2023-06-15 12:00:00": "about 1 year ago",
             "2021-01-01 00:00:00": "over 3 years ago", "2025-05-01 00:00:00": "in 11 months", "2020-08-01 00:00:00": "almost 4 years ago"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", access.distance(F.col("t").cast("timestamp"), F.lit(now).cast("timestamp")).alias("d")).collect()
    assert {g["t"]: g["d"] for g in got} == cases
    assert value(spark, access.distance(F.lit(None).cast("timestamp"), F.current_timestamp())) is None


def test_corrections_grow(spark):
    base = spark.createDataFrame([], "incorrect_text string, corrected_member_id string, frequency long")
    batch = spark.createDataFrame([("x", "m1", 1), ("x", "m2", 2)], "incorrect_text string, member_id string, seq int")
    assert approvals.learn_corrections(base, batch).first().asDict() == {"incorrect_text": "x", "corrected_member_id": "m2", "frequency": 2}


def test_lookups(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, full_name string").withColumn("email", F.lit(None).cast("string"))
    assert access.one(table, "id", 1).first()["full_name"] == "a"
    for missing in (2, 3):
        with pytest.raises(LookupError):
            access.one(table, "id", missing)
    assert access.search_members(table, "").count() == 3 and access.search_members(table, "B").count() == 1


def test_replay(spark):
    ops = [("edit", "a"), ("edit", "b"), ("undo", None), ("undo", None), ("undo", None), ("redo", None), ("edit", "c"), ("redo", None)]
    log = spark.createDataFrame([("s", i, op, v) for i, (op, v) in enumerate(ops)], "session_id string, seq int, op string, version string")
    assert edits.replay_versions(log).first().asDict() == {"session_id": "s", "version": "c", "n_versions": 3}


def test_heal(spark):
    cells = [("d", r, c, t, 90.0, False, None, None) for r, row in enumerate([["Sr", "Name", "Total"], ["l.", "ada lovelace", "1O"]]) for c, t in enumerate(row)]
    cells += [("d", 5, 0, "2", 50.0, False, "3.", 80.0), ("d", 5, 1, "grace", 60.0, False, "grace hopper", 50.0), ("d", 5, 2, "x7", 90.0, False, None, None), ("d", 6, 0, " ", 0.0, True, None, None)]
    df = spark.createDataFrame(cells, "doc_id string, row_idx int, col_idx int, text string, confidence double, is_empty boolean, fallback_text string, fallback_confidence double")
    got = {r["row_idx"]: r for r in healing.heal(df).collect()}
    assert got[0]["is_header"] and got[1]["columns"] == ["1", "Ada Lovelace", "10"]
    assert got[5]["columns"] == ["3", "Grace", "7"] and "Healed" in got[5]["heal_note"]
    assert 6 not in got


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, ["A", 'q"'], True, None, "n"), ("s", 1, ["1", "2"], False, "data", "n"), ("s", 2, ["t"], False, "title", "n"), ("s", 3, None, False, None, "n")], "session_id string, row_idx int, columns array<string>, is_header boolean, region string, ocr_name string")
    assert exports.to_csv(rows).first()["csv"] == '"A","q"""\n"1","2"\n'
    assert exports.to_tsv(rows).first()["tsv"] == 'A\tq"\n1\t2\n'
    assert [tuple(r)[2:] for r in exports.to_wide(rows, exports.widest(rows)).orderBy("row_idx").collect()] == [("A", 'q"'), ("1", "2"), ("t", None), ("n", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('email,full_name\n\na@x,"Lovelace, Ada"\n')
    got = readers.read_roster(spark, str(tmp_path / "r.csv")).collect()
    assert [r["full_name"] for r in got] == ["Lovelace, Ada"] and got[0]["aliases"] is None
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "img/b.txt").write_bytes(b"hello")
    (tmp_path / "img/c.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt ")
    (tmp_path / "img/d.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8 ")
    taken, rejected = readers.guard_images(readers.read_images(spark, str(tmp_path / "img")))
    assert sorted(r["kind"] for r in taken.collect()) == ["image/png", "image/webp"] and rejected.count() == 2


def test_intake_passes_each_batch_on(spark, tmp_path):
    schema = "session_id string, row_idx int, member_id string, is_header string, present boolean"
    sessions = spark.createDataFrame([("s", "e")], "id string, event_name string").withColumn("session_date", F.lit("2024-01-01").cast("date"))
    facts = {}

    def upsert(batch, number):
        facts.update({(r["session_id"], r["member_id"]): (r["present"], number) for r in batch.collect()})

    for k, present in enumerate((True, False)):
        spark.createDataFrame([("s", 1, "m1", None, present), ("s", 2, f"x{k}", None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        intake.take_in(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sessions, upsert, str(tmp_path / "check")).awaitTermination(60)
    assert facts == {("s", "m1"): (False, 1), ("s", "x0"): (True, 0), ("s", "x1"): (True, 1)}


def test_merge_up_over_rows_without_cells(spark):
    rows = spark.createDataFrame([("s", "a", 0, ["x"]), ("s", "b", 1, None), ("s", "c", 2, ["y"])], "session_id string, row_id string, row_idx int, columns array<string>")
    merges = rows.filter("row_idx > 0").select("session_id", "row_id")
    assert [r["columns"] for r in edits.merge_up(rows, merges).collect()] == [["x", "y"]]


def test_recognise_and_enrich(spark):
    cells = spark.createDataFrame([("d", 0, 0, bytearray(b"ab")), ("d", 0, 1, None), ("d", 0, 2, bytearray(b""))], "doc_id string, row_idx int, col_idx int, image binary")
    got = recognise.recognise(cells, lambda image: (chr(image[0]), 77.0)).orderBy("col_idx").collect()
    assert [(g["text"], g["confidence"], g["is_empty"]) for g in got] == [("a", 77.0, False), ("", 100.0, True), ("", 0.0, False)]
    read = spark.createDataFrame([("d", 0, ["x"], True, 61.0)], "doc_id string, row_idx int, columns array<string>, is_header boolean, confidence double")
    matched = spark.createDataFrame([("d", 0, "m1", 1.0), ("d", 1, None, 0.0)], "doc_id string, row_idx int, member_id string, confidence double")
    both = {r["row_idx"]: r for r in recognise.enrich(matched, read, ["doc_id", "row_idx"]).collect()}
    assert both[0]["ocr_confidence"] == 61.0 and both[0]["confidence"] == 1.0 and both[1]["columns"] is None


def test_preprocess_keeps_channels_and_bytes(spark):
    """Red, a mixed colour, and a value that rounding to 8 bits brings to the threshold."""
    p = spark.createDataFrame([(1, 0, 0, 255, 0, 0), (1, 0, 1, 10, 20, 30), (1, 0, 2, 128, 127, 127)], "img_id int, y int, x int, r int, g int, b int")
    seen = lambda **how: [tuple(x)[3:] for x in grid.preprocess(p, **how).orderBy("x").collect()]
    assert seen() == [(54, 54, 54), (19, 19, 19), (127, 127, 127)]
    assert seen(grayscale=False) == [(255, 0, 0), (10, 20, 30), (128, 127, 127)]
    assert seen(threshold=127) == [(0, 0, 0)] * 3 and seen(contrast=-1.0) == [(128,) * 3] * 3
    assert seen(brightness=0.5, grayscale=False)[1] == (138, 148, 158)  # halves to even
    assert seen(sharpen=True)[0] == (251, 251, 251)


def test_labels_and_names(spark):
    labels = [(value(spark, access.status_label(F.lit(s))), value(spark, access.action_label(F.lit(s)))) for s in ("approved", "refining", "pending")]
    assert labels == [("Approved", "Completed"), ("In Review", "Continue Approval"), ("Pending", "Continue Approval")]
    names = [value(spark, approvals.session_name(F.lit(n).cast("string"), F.lit("2024-03-05").cast("date"))) for n in ("  a ", " ", "", None)]
    assert names == ["  a ", " ", "Attendance — 05 Mar 2024", "Attendance — 05 Mar 2024"]


def plain_spread(ink, rx, ry, every):
    h, w = ink.shape
    out = np.zeros_like(ink)
    for y in range(h):
        for x in range(w):
            around = ink[max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1]
            out[y, x] = around.all() and around.size == (2 * rx + 1) * (2 * ry + 1) if every else around.any()
    return out


def pixel_rows(spark, images):
    return spark.createDataFrame([(i, y, x, int(ink[y, x])) for i, ink in enumerate(images) for y in range(ink.shape[0]) for x in range(ink.shape[1])], "img_id int, y int, x int, v int")


def test_running_windows_over_words(spark):
    r = np.random.default_rng(6)
    images = [r.random((9, 150)) < 0.1, r.random((30, 64)) < 0.93, r.random((1, 1)) < 2, r.random((5, 200)) < 0.9]
    words = scan.pack(pixel_rows(spark, images)).cache()
    for kx, ky in ((20, 2), (2, 20), (1, 1), (140, 3), (3, 3)):
        for step, every in ((scan.dilate, False), (scan.erode, True)):
            got = [np.zeros_like(i) for i in images]
            for p in scan.unpack(step(words, kx, ky)).collect():
                got[p["img_id"]][p["y"], p["x"]] = p["v"]
            assert all((a == plain_spread(i, kx // 2, ky // 2, every)).all() for a, i in zip(got, images, strict=True)), (kx, ky, every)


def test_components_over_runs(spark):
    r = np.random.default_rng(7)
    spiral = np.ones((19, 90), bool)
    for k in range(1, 19, 2):
        spiral[k, : 89 if k % 4 == 1 else 90] = False
        spiral[k, 89 if k % 4 == 1 else 0] = True
    images = [r.random((12, 700)) < 0.6, spiral, r.random((40, 40)) < 0.5, np.zeros((3, 3), bool), np.ones((4, 65), bool)]
    got = {}
    for p in scan.components(scan.pack(pixel_rows(spark, images))).orderBy("img_id", "part").collect():
        got.setdefault(p["img_id"], []).append(tuple(p)[2:])
    for i, ink in enumerate(images):
        assert sorted(got.get(i, [])) == sorted(grid.components_of(ink))
        order = [(b[1], b[0]) for b in got.get(i, [])]
        assert [y for y, _ in order] == sorted(y for y, _ in order)


def test_segments_of_images_of_any_size(spark):
    """Bounds of the plain loops, over images larger and smaller than the size that is analysed."""
    r = np.random.default_rng(9)

    def loops(rgb):
        h, w = rgb.shape[:2]
        scale = max(1.0, max(w, h) / 1000)
        sw, sh = (1000, int(h / scale + 0.5)) if w > h and w > 1000 else (int(w / scale + 0.5), 1000) if h > 1000 else (w, h)
        at = lambda n: np.floor((np.arange(n) + 0.5) * scale).astype(int)
        small = rgb[at(sh)][:, at(sw)].astype(float)
        ink = small @ np.array([0.2126, 0.7152, 0.0722]) < 160
        bounds = []
        for spread, axis, threshold, gap in ((plain_spread(ink, 10, 1, False), 1, 0.015, 8), (plain_spread(ink, 1, 10, False), 0, 0.005, 10)):
            share, found, start = (spread.sum(axis) / spread.shape[axis]).astype(np.float32), [0], None
            for i, s in enumerate(share.tolist()):
                if s <= threshold:
                    start = i if start is None else start
                elif start is not None:
                    if i - start >= max(3, int(gap / scale + 0.5)):
                        found.append(int((start + i) / 2 + 0.5))
                    start = None
            bounds.append([int(b * scale + 0.5) for b in [*found, len(share) - 1]])
        rows, columns = bounds
        return {(i, j, columns[j] + 3, rows[i] + 3, max(20, columns[j + 1] - columns[j] - 6), max(20, rows[i + 1] - rows[i] - 6)) for i in range(len(rows) - 1) for j in range(len(columns) - 1)}

    images = []
    for h, w in ((1300, 40), (60, 1105), (90, 130), (1, 1)):
        rgb = np.full((h, w, 3), 255, np.uint8)
        rgb[(np.arange(h) % 40 < 12)[:, None] & (np.arange(w) % 45 < 15)] = r.integers(0, 150, 3)
        images.append(rgb)
    data = [(i, f"P6 {im.shape[1]} {im.shape[0]} ".encode() + im.tobytes()) for i, im in enumerate(images)] + [(7, b"P6 2 2 short"), (8, None), (9, b"")]

    def decode(content):
        _, w, h, rest = content.split(b" ", 3)
        return int(w), int(h), rest

    lines = recognise.scan_lines(spark.createDataFrame(data, "img_id int, content binary"), decode).cache()
    assert sorted(x["img_id"] for x in lines.filter("error is not null").collect()) == [7, 8, 9]
    pixels = lines.filter("error is null").select("img_id", "y", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: F.hex(F.substr(F.col("line"), x * 3 + 1, F.lit(3))))).alias("x", "p"))
    pixels = pixels.select("img_id", "y", "x", *(F.conv(F.substring("p", k, 2), 16, 10).cast("int").alias(c) for k, c in ((1, "r"), (3, "g"), (5, "b"))))
    for found in (scan.segment_lines(lines.filter("error is null")), scan.segment(pixels)):
        got = [{tuple(c)[1:] for c in found.filter(F.col("img_id") == i).collect()} for i in range(len(images))]
        assert got == [loops(im) for im in images]


def test_second_reading_of_weak_cells_alone(spark, tmp_path):
    """A recogniser that notes what it is given; only cells below 70 in weak rows are read again."""
    data = [["Sr", "Name", "Total"], ["l.", "ada lovelace", "1O"], ["2", "bob", "3"], ["3", "cy", "4"], ["4", "dora", "5"], ["5", "ed", "6"], [None, None, None]]
    sure = {(4, 1): 60.0, (5, 0): 50.0, (5, 1): 65.0, (5, 2): 71.0}
    cells = [("d", r, c, None if t is None else f"{sure.get((r, c), 90.0)}|{t}".encode(), c * 10, r * 40, c * 10 + 8, r * 40 + 30) for r, row in enumerate(data) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id string, row_idx int, col_idx int, image binary, x0 int, y0 int, x1 int, y1 int")
    folder = str(tmp_path)

    def first(image):
        confidence, text = image.decode().split("|")
        return text, float(confidence)

    def second(image):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "wb").write(image)
        return image.decode().split("|")[1].upper() + "!", 80.0

    got = {r["row_idx"]: r for r in healing.read_sheets(df, first, second).collect()}
    seen = {f.read_bytes() for f in tmp_path.iterdir()}
    assert seen == {b"50.0|5", b"65.0|ed"} and len(list(tmp_path.iterdir())) == 2
    assert sorted(got) == [0, 1, 2, 3, 4, 5] and got[0]["region"] == "header" and got[4]["columns"][1] == "Dora"
    assert "Healed" in got[5]["heal_note"] and got[5]["confidence"] == (80.0 + 80.0 + 71.0) / 3
    assert tuple(got[5]["structural_confidence"]) == (95.0, 90.0, (185 + got[5]["confidence"]) / 3)
    assert tuple(got[5]["bbox"]) == (0, 200, 28, 230) and got[5]["empty_cells"] == [False] * 3
    assert healing.read_sheets(df.limit(0), first, second).count() == 0


@pytest.mark.parametrize("known", [False, True])
def test_segmenting_reads_pixels_once(spark, known):
    """What remains to be run reads written words, not the pixels again; widths end within and at the end of a word."""
    sizes = ((0, 1100, 30), (1, 64, 20), (2, 65, 9))
    r = spark.range(40000).select(*(F.expr(f"CASE {' '.join(f'WHEN id < {n} THEN {v}' for n, v in ((33000, a), (34280, b), (34865, c)))} END").alias(name) for name, a, b, c in (
        ("img_id", 0, 1, 2), ("w", *(w for _, w, _ in sizes)), ("h", *(h for _, _, h in sizes)), ("at", "id", "id - 33000", "id - 34280"))))
    white = F.when(F.col("at") % F.col("w") % 40 < 20, 0).otherwise(255)
    pixels = r.filter("at is not null").select("img_id", *(("w", "h") if known else ()), F.expr("cast(at div w as int)").alias("y"), F.expr("cast(at % w as int)").alias("x"), *(white.alias(c) for c in "rgb"))
    found = scan.segment(pixels)
    assert "Range (0, 40000" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(row["img_id"], row["col_idx"]): (row["x"], row["w"]) for row in found.collect() if row["row_idx"] == 0}
    assert got[1, 0][0] == 3 and max(x + w + 3 for (i, _), (x, w) in got.items() if i == 1) == 63 and max(x + w + 3 for (i, _), (x, w) in got.items() if i == 2) == 64


def test_sheets_are_judged_once(spark):
    """What remains after the second reading infers no kinds again; rows with absent cells keep their places."""
    cells = [("d", r, c, f"{r}|x{c}".encode(), 0, 0, 1, 1) for r in range(6) for c in ((0, 1, 2, 3) if r == 0 else (1, 3) if r == 5 else (0, 1))]
    df = spark.createDataFrame(cells, "doc_id string, row_idx int, col_idx int, image binary, x0 int, y0 int, x1 int, y1 int")
    found = healing.read_sheets(df, lambda i: (i.decode().split("|")[1], 60.0), lambda i: (i.decode().split("|")[1] + "!", 80.0))
    assert "samples" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["row_idx"]: r["columns"] for r in found.collect()}[5] == ["", "x1!", "", "x3!"]


def test_words_stream_through_their_task(spark):
    """Random words against a plain search of all rows; one document is longer than a batch, one has no id."""
    from sheetloom.operators import words as W

    r = np.random.default_rng(3)
    docs = [(d, n, tall) for d, (n, tall) in enumerate(((12000, 9.0), (40, 60.0), (1, 5.0), (300, 20.0)))]
    data = [(d or None, i, "t", 1.0, 0.0, float(y), 1.0, float(y + r.uniform(0, tall))) for d, n, tall in docs for i, y in enumerate(r.uniform(0, n / 4 + 50, n))]
    df = spark.createDataFrame(data, "doc_id int, word_ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double").orderBy(F.rand(5))
    found = W.cluster_rows(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(p["doc_id"], p["word_ord"]): (p["row_idx"], p["row_y"], p["row_height"]) for p in found.collect()}
    for d, _, _ in docs:
        means, counts, heights, member = [], [], [], []
        for p in (p for p in data if p[0] == (d or None)):
            middle, height = (p[5] + p[7]) / 2, p[7] - p[5]
            at = next((k for k, m in enumerate(means) if abs(m - middle) < max(14.0, 0.45 * height)), len(means))
            if at == len(means):
                means, counts, heights = [*means, middle], [*counts, 1], [*heights, height]
            else:
                means[at], counts[at], heights[at] = (means[at] * counts[at] + middle) / (counts[at] + 1), counts[at] + 1, max(heights[at], height)
            member.append(at)
        rank = {k: i for i, k in enumerate(sorted(range(len(means)), key=lambda k: means[k]))}
        assert all(got[d or None, i] == (rank[k], means[k], heights[k]) for i, k in enumerate(member))


def test_rows_are_held_unfilled(spark):
    """A sheet of one wide row and many narrow ones: what is sorted and dealt grows with its cells, not with rows by columns."""
    n = 300
    at = spark.range(2 * n - 1).select(F.lit("d").alias("doc_id"), F.greatest(F.col("id") - n + 1, F.lit(0)).cast("int").alias("row_idx"), F.when(F.col("id") < n, F.col("id")).otherwise(0).cast("int").alias("col_idx"))
    cells = at.select("*", F.lit("word").alias("text"), F.lit(90.0).alias("confidence"), F.lit(False).alias("is_empty"))
    held = healing._judged(healing.to_rows(cells))
    assert held.agg(F.sum(F.size("cells")), F.sum(F.size("columns")), F.sum(F.size("kinds"))).first() == (2 * n - 1,) * 3
    fallback = cells.withColumns({"fallback_text": F.lit(None).cast("string"), "fallback_confidence": F.lit(None).cast("double")})
    assert healing.heal(fallback).agg(F.sum(F.size("columns")), F.sum(F.size("empty_cells"))).first() == (n * n,) * 2
    weak = {tuple(r) for r in healing.weak_cells(cells.filter("row_idx < 2")).collect()}
    assert weak == {("d", 1, i) for i in range(1, n)}
