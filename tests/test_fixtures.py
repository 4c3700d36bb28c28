"""Hand-made cases with the exact rows expected."""

from pyspark.sql import functions as F

from policyflow import names
from policyflow.functions import codes, numbers, tags, text as tx
from policyflow.operators import (
    assembly, containment, files, lookups, merge, project, quality, ranges, responses, review, sections, structures, vote,
)
from policyflow.sources import tables as src


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- codes and ranges

TABLE = [("C00", "C97", "0A1"), ("C00", "D09", "0A9"), ("I60", "I63", "0B1"), ("C44", None, "0C1"), ("", "Z99", "0X1")]
CODES = ["C34", "C34.1", "C97.9", "D05", "D99", "I61", "C44", " c44 ", "", None]


def range_rows(rows, mode="reference", whole=False):
    df = rows([(c,) for c in CODES], "code_in string")
    table = rows(TABLE, "FROM string, TO string, 분류번호 string")
    out = ranges.map_codes(df, "code_in", table, "FROM", "TO", "분류번호", mode, whole)
    return {(r["code_in"], r["code"]) for r in out.collect()}


def test_range_reference(rows):
    assert range_rows(rows) == {
        ("C34", "0A1"), ("C34.1", "0A1"), ("C44", "0A1"), ("C44", "0C1"), (" c44 ", "0A1"), (" c44 ", "0C1"),
        ("D05", "0A9"), ("D99", "0A9"), ("I61", "0B1"),
    }


def test_range_ordered_and_whole(rows):
    ordered = range_rows(rows, "ordered")
    assert ("C34", "0A9") in ordered and ("D99", "0A9") not in ordered and ("D05", "0A9") in ordered
    assert ("C97.9", "0A1") in range_rows(rows, whole=True)
    assert ("C97.9", "0A1") not in range_rows(rows)


def test_parse(spark):
    got = value(spark, codes.parse(F.lit("c34.1x")))
    assert (got["alpha"], got["num"]) == ("C", 34.1)
    got = value(spark, codes.parse(F.lit("암")))
    assert (got["alpha"], got["num"]) == ("암", 0.0)


def test_range_columns():
    assert ranges.find_range_columns(["시작코드", "종료코드", "분류번호"]) == {"from": "시작코드", "to": "종료코드", "code": "시작코드"}
    assert ranges.find_range_columns(["name", "FROM"]) is None
    assert ranges.find_range_columns(["FROM", "CUSTOMER", "CODE"])["to"] == "CUSTOMER"


def test_any_column_match(rows):
    out = ranges.map_to_table(rows([("b1",)], "c string"), "c", rows([(0, "k", "B1"), (1, "b1 ", "x")], "pos long, id string, other string"), "pos")
    assert pairs(out, "code", "column") == [("b1 ", "id"), ("k", "other")]


# --- lookups

def test_exact_beats_suffix(rows):
    table = rows([(0, "ZA1234567", "suffix"), (1, "ZX1234567", "exact")], "pos long, code string, rep string")
    df = rows([("ZX1234567",), ("ZQ1234567",), ("none",)], "c string")
    out = lookups.tiered_lookup(df, table, "c", "code", ["rep"], "pos")
    assert pairs(out, "c", "rep", "check") == [("ZQ1234567", "suffix", ""), ("ZX1234567", "exact", ""), ("none", "", names.LOOKUP_ERROR)]
    old = lookups.tiered_lookup(df, table, "c", "code", ["rep"], "pos", priority="row_order")
    assert pairs(old, "c", "rep")[1] == ("ZX1234567", "suffix")


def test_multi_lookup(rows):
    table = rows([(0, "a", "r1", "x"), (1, "b", "r2", "x"), (2, "b", "r1", "y"), (3, "b", "r2", "z")], "pos long, code string, rep string, cat string")
    df = rows([("a",), ("b",), ("c",)], "c string")
    out = lookups.multi_lookup(df, table, "c", "code", "rep", "cat", "pos", F.lit(False))
    assert pairs(out, "c", "rep_code", "category", "rep_codes") == [
        ("a", "r1", "x", ""), ("b", "", "z", "r2,r1"), ("c", names.LOOKUP_ERROR, "", ""),
    ]


ITEMS = [("암진단비", "일반"), ("뇌출혈진단비", "뇌"), ("수술비", ""), (None, "x"), ("무관", "전혀")]
ANSWERS = [
    (0, "암진단비(유사암제외)", "일반형", "near"), (1, "암진단비", "일반", "exact"), (2, "암진단비", "일반", "exact-last"),
    (3, "뇌출혈", "뇌", "inside"), (4, "", "", "any"),
]


def test_match_responses(rows):
    items = rows(ITEMS, "benefit_name string, template_name string")
    answers = rows(ANSWERS, "pos long, benefit_name string, template_name string, inferred_code string")
    out = containment.match_responses(items, answers, "benefit_name", "template_name", ["inferred_code"], "pos")
    got = {(r["benefit_name"], r["template_name"]): (r["inferred_code"], r["matched"]) for r in out.collect()}
    assert got == {
        ("암진단비", "일반"): ("exact-last", True), ("뇌출혈진단비", "뇌"): ("inside", True), ("수술비", ""): ("any", True),
        (None, "x"): ("", False), ("무관", "전혀"): ("any", True),
    }


def test_reason(rows):
    df = rows([("s", True), ("", True), ("", False)], "sentence string, matched boolean")
    out = df.select(containment.reason(F.lit("A"), F.col("sentence"), F.col("matched"), names.UNMATCHED).alias("r")).collect()
    assert [r["r"] for r in out] == ["[A] s", "", "[A] " + names.UNMATCHED]


# --- vote and gate

def test_vote(rows):
    schema = "n int, inferred_code string, confidence string, source string, ref_page string, ref_sentence string"
    cases = [  # primary code, label, secondary code, label -> score, label, code
        ("A1", "high", "a 1", "high", 1.0, "high", "A1"), ("A", "high", "A", "low", 0.825, "medium", "A"),
        ("A", "medium", "A", "medium", 0.85, "high", "A"), ("A", "high", "B", "low", 0.665, "medium", "A"),
        ("A", "low", "B", "high", 0.665, "medium", "B"), ("", "low", "", "low", 0.55, "low", ""), ("A", "high", "A", "medium", 0.975, "high", "A"),
        ("A", "medium", "B", "low", 0.49, "low", "A"), ("A", "low", "B", "low", 0.28, "low", "A"),
    ]
    p = rows([(i, c[0], c[1], "p", "1", "ps") for i, c in enumerate(cases)], schema)
    s = rows([(i, c[2], c[3], "s", "2", "ss") for i, c in enumerate(cases)], schema).withColumn("pos", F.col("n"))
    got = {r["n"]: r for r in vote.vote_batch(p, s, ["n"], "pos").collect()}
    for i, c in enumerate(cases):
        assert (got[i]["score"], got[i]["label"], got[i]["final_code"]) == c[4:], c
    assert got[4]["source"] == "s" and got[3]["source"] == "p"


def test_vote_without_secondary(rows):
    schema = "n int, inferred_code string, confidence string, source string, ref_page string, ref_sentence string"
    p = rows([(1, "A", "medium", "p", "1", "x"), (2, "A", "odd", "p", "1", "x")], schema)
    got = {r["n"]: r for r in vote.vote_batch(p, p.limit(0).withColumn("pos", F.col("n")), ["n"], "pos").collect()}
    assert (got[1]["score"], got[1]["final_code"], got[1]["agreement"]) == (0.49, "A", False)
    assert (got[2]["score"], got[2]["final_code"]) == (0.28, "")  # an unknown label loses to an absent answer


def test_gate(rows):
    df = rows([(1, 0.95), (2, 0.949), (3, None)], "id int, confidence double")
    out = review.gate(df)
    assert pairs(out, "id", "verification_status") == [(1, "auto_confirmed"), (2, "review_needed"), (3, "review_needed")]
    assert review.new_queue(out).count() == 2


def test_transfer_state(spark):
    cases = [(True, 0, "completed", 0), (False, 0, "pending", 1), (False, 1, "pending", 2), (False, 2, "failed", 3)]
    for ok, n, status, after in cases:
        state = review.transfer_state(F.lit(ok), F.lit(n))
        assert (value(spark, state["status"]), value(spark, state["retry_count"])) == (status, after)


# --- responses

def parsed(spark, raw):
    got = value(spark, responses.parse_response(F.lit(raw), ["benefit_name", "inferred_code"]))
    return [(o["benefit_name"], o["inferred_code"]) for o in got]


def test_parse_response(spark):
    assert parsed(spark, '```json\n[{"benefit_name": "a", "inferred_code": 1}, {"benefit_name": "b"}]\n```') == [("a", "1"), ("b", None)]
    assert parsed(spark, 'x [{"benefit_name": "a"}, {"benefit_name": bad}, {"benefit_name": "c"},] y') == [("a", None), ("c", None)]
    assert parsed(spark, '{"benefit_name": "a"}') == []
    assert parsed(spark, "[]") == []
    assert parsed(spark, '] {"benefit_name": "a"} [') == [("a", None)]
    assert value(spark, responses.parse_fenced(F.lit('x [{"benefit_name": "a"}]'), ["benefit_name"])) is None


def test_prompt_budget(rows):
    df = rows([("g", 0, "a", "x" * 60), ("g", 1, "b", ""), ("g", 2, "c", "y" * 60), ("g", 3, "d", "z")], "g string, pos long, name string, content string")
    text = responses.budget_text(df, ["g"], "pos", "name", "content", 100).first()["text"]
    first = "\n=== a ===\n" + "x" * 60 + "\n"
    assert text == first + "\n=== c ===\n" + "y" * (100 - len(first)) + "\n"


# --- tags

def control(spark, text, exempt):
    ctx = F.struct(
        F.lit(exempt).alias("exempt"), *[F.lit(0).alias(c) for c in ("reduce", "confirm", "renew", "no_renew", "independent")],
        F.lit(True).alias("once"), F.lit(False).alias("twice"),
    )
    return value(spark, tags.render_control(F.lit(text), tags.attribute_truth(ctx)))


def test_control_tags(spark):
    text = "a{면책0-1}b{면책0-2}c{면책0-3}d{면책0-4}e"
    assert control(spark, text, 1) == "abce"
    assert control(spark, text, 0) == "acde"
    assert control(spark, "{감액한번3-1}x{감액한번3-2}{감액두번1-1}y{감액두번1-2}", 0) == "x"
    assert control(spark, "{비갱신0-1}x{비갱신0-2}{갱신0-1}y{갱신0-2}", 0) == "x"
    assert control(spark, "{면책0-1}a$1\\b", 1) == "{면책0-1}a$1\\b"  # no closing tag: nothing happens


def test_phrases(rows):
    table = rows([
        (0, "{감액1}", "감액", "", "never"), (1, "{감액1}", "감액", "1", "late"), (2, "{단체1}", "단체", "x", "bad"), (3, "{단체1}", "단체", "1", "team"),
        (4, "{단체1}", "다른", "1", "other"), (5, "{보통약관 해약환급금}", "", "0", "refund"),
    ], "pos long, 코드명 string, 담보속성 string, 적용구분 string, 적용문구 string")
    index = assembly.phrase_index(assembly.phrase_table(table, "pos"))
    asked = rows([("{감액1}", "감액", 1), ("{단체1}", "단체", 1), ("{단체1}", "단체", 0), (tags.REFUND_TAG, None, None)], "tag string, attribute string, wanted int")
    got = {(r["tag"], r["wanted"]): r["phrase"] for r in assembly.find_phrases(asked, index).collect()}
    assert got == {("{감액1}", 1): "", ("{단체1}", 1): "team", ("{단체1}", 0): "", (tags.REFUND_TAG, None): "refund"}


def test_periods_and_rates(spark):
    cases = {0: "", 7: "7일", 30: "1개월", 45: "45일", 90: "3개월", 365: "1년", 400: "400일", 730: "2년"}
    for days, text in cases.items():
        assert value(spark, numbers.period_text(F.lit(days))) == text
    lit = F.lit
    assert value(spark, numbers.rate_text(lit(50.0), lit("*"), lit("2"), lit("%"))) == "100%"
    assert value(spark, numbers.rate_text(lit(50.0), lit("/"), lit("3"), lit(""))) == "16.7"
    assert value(spark, numbers.rate_text(lit(50.0), lit(""), lit(""), lit(None).cast("string"))) == "50"


def test_names_and_kth(spark):
    names_ = F.array(F.lit("a"), F.lit(""), F.lit("c"))
    get = lambda n: numbers.pick(names_, n)
    text = tags.map_matches(F.lit("{세부보장1}{세부보장2}{세부보장3}{세부보장10}{세부보장0}"), tags.NAME_TAG, lambda t: tags.name_answer(t, get))
    assert value(spark, text) == "「a」「c」「c」"
    text = tags.map_matches(F.lit("x{세부보장99999999999}y"), tags.NAME_TAG, lambda t: tags.name_answer(t, get))
    assert value(spark, text) == "xy"
    periods = F.array(F.array(F.lit(90), F.lit(30)))
    get = lambda n: numbers.pick(periods, n)
    text = tags.map_matches(F.lit("{감액기간1-1}/{감액기간1-2}/{감액기간1-3}"), tags.PERIOD_TAG, lambda t: tags.period_answer(t, get))
    assert value(spark, text) == "1개월/3개월/NA"


def test_zero_age(spark):
    text = F.lit("a #{0세자녀-1}b\nc{0세자녀-2}d")
    assert value(spark, tags.zero_age(text, F.lit(0))) == "a #d"
    assert value(spark, tags.zero_age(text, F.lit(1))) == "a b\ncd"


# --- structures

def test_ascending_run(rows):
    keys = {"k1": [0, 1, 2, 3], "k2": [1, 2], "k3": [0, 1, 1, 2], "k4": [5]}
    data = [(k, i * 3, s) for k, seq in keys.items() for i, s in enumerate(seq)]
    run = structures.ascending_run(rows(data, "key string, row_no long, seq int"), "key", "row_no", "seq", width=4)
    assert pairs(structures.run_length(run, "key"), "key", "sub_count") == [("k1", 3), ("k2", 1), ("k3", 1), ("k4", 0)]


def test_benefit_names_of_a_coverage(rows):
    """Two structure rows with sequence 1 and 2 below the header row give two names."""
    cov = rows([("D123",)], "coverage_code string")
    model = rows([("D123", 0, "01")], "coverage_code string, row_no long, expansion string")
    structure = rows([("P123_01", 0, 0, "m0", "H"), ("P123_01", 1, 1, "m1", "SC001"), ("P123_01", 2, 2, "m2", "SC002")],
                     "key string, row_no long, sequence int, multiple_key string, sub_code string")
    multiple = rows([("m1", 0, "50"), ("m1", 1, "70")], "multiple_key string, row_no long, rate string")
    subs = structures.structure_chain(cov, model, structure, multiple, F.lit("P123"))
    assert pairs(subs.na.fill(""), "sub_no", "sub_code", "rate") == [(1, "SC001", "50"), (2, "SC002", "")]
    mapping = rows([(0, "SC001", "SubCoverage1"), (1, "SC002", "SubCoverage2")], "pos long, code string, name string")
    out = lookups.sub_names(subs, mapping, ["coverage_code"], "sub_no", "sub_code", "code", "name", "pos")
    assert pairs(out, "sub_no", "name") == [(1, "SubCoverage1"), (2, "SubCoverage2")]


# --- sections

POLICY = """머리말
1. 앞선 항목
제1조(목적) 나머지
1. 항 앞의 호
본문
① 첫째 항
 1. 호 하나
줄
② 둘째
제2조의2（정의）
③ 셋째 항"""


def test_articles(rows):
    out = [r.asDict(True) for r in sections.article_rows(rows([(1, POLICY)], "id int, text string")).orderBy("article_no").collect()]
    assert [(a["number"], a["title"], a["content"]) for a in out] == [("제1조", "목적", "1. 항 앞의 호\n본문\n줄\n"), ("제2조의2", "정의", "")]
    assert [(p["marker"], p["text"], [(i["number"], i["text"]) for i in p["items"]]) for p in out[0]["paragraphs"]] == [
        ("①", "첫째 항", [("1", "호 하나")]), ("②", "둘째", []),
    ]
    assert [p["marker"] for p in out[1]["paragraphs"]] == ["③"]


def test_appendices(rows):
    text = "앞 별표[질병관련1] 내용 하나 별표 2 <!-- Page 7 --> 내용 둘"
    out = sections.appendix_rows(rows([(text,)], "text string"))
    assert pairs(out, "pos", "name", "start_page", "content") == [
        (1, "별표[질병관련1]", 0, "내용 하나"), (2, "별표 2", 7, "<!-- Page 7 --> 내용 둘"),
    ]


def test_chunks(rows):
    out = sections.chunk_rows(rows([("x" * 20000,)], "text string"))
    assert pairs(out, "part_no", "title", "char_count") == [(i + 1, f"메인 약관 (part {i + 1})", n) for i, n in enumerate([8000, 8000, 4000])]
    out = sections.chunk_rows(rows([(" 머리 무배당 암진단 특약 약관 내용 제1관 수술 특약   ",)], "text string"))
    assert pairs(out, "title", "content") == [("메인 약관", "머리"), ("무배당 암진단 특약 약관", "내용")]


def test_empty_text_is_an_error(rows):
    out = sections.preprocess(rows([(1, ""), (2, "x")], "id int, text string"))
    assert pairs(out.na.fill(""), "id", "error") == [(1, "empty text"), (2, "")]


def test_page_text(spark):
    table = lambda *r: F.array(*[F.array(*[F.lit(c).cast("string") for c in row]) for row in r])
    tables = F.array(table(["h", "i"], ["1", None]))
    got = value(spark, sections.page_piece(F.lit(3), F.lit("text"), tables))
    assert got == "\n<!-- Page 3 Table -->\n| h | i |\n|---|---|\n| 1 |  |\n"
    assert value(spark, sections.page_piece(F.lit(3), F.lit("text"), F.array(table(["h"])))) == ""
    none = F.array().cast("array<array<array<string>>>")
    assert value(spark, sections.page_piece(F.lit(3), F.lit("text"), none)) == "\n<!-- Page 3 -->\ntext\n"
    assert value(spark, sections.page_piece(F.lit(3), F.lit(" \n"), none)) == ""


# --- files

def test_most_recent(rows):
    data = [(0, "약관_상해_1", 1), (1, "상해질병_2", 9), (2, "상해_3", 5), (3, "상해_4", 5)]
    df = rows(data, "pos long, name string, t long").withColumn("mtime", F.timestamp_seconds("t"))
    out = files.most_recent(df, ["상해", "상해질병", "펫"], "name", "mtime", "pos")
    assert pairs(out, "term", "name") == [("상해", "상해_3"), ("상해질병", "상해질병_2"), ("펫", "-")]


def test_rider_files(rows):
    data = [(0, "12_일반_x", 1), (1, "12_간편_y", 2), (2, "abc", 3), (3, "12_z", 4)]
    df = rows(data, "pos long, name string, t long").withColumn("mtime", F.timestamp_seconds("t"))
    out = files.rider_files(df, "name", "mtime", "pos")
    assert pairs(out, "group_no", "normal_file", "simple_file") == [(-1, "abc", ""), (12, "12_z", "12_간편_y")]


def test_paths(spark):
    cases = {"/a/b/c.tar.gz": ("c.tar", "b", ".gz"), "x.PDF": ("x", "default_group", ".pdf"), "/d/.hidden": (".hidden", "d", ""), "C:\\r\\f.txt": ("f", "r", ".txt")}
    for path, want in cases.items():
        p = F.lit(path)
        assert (value(spark, tx.stem(p)), value(spark, tx.folder_name(p)), value(spark, tx.extension(p))) == want


def test_grouping(rows):
    one = rows([("/r/RefA.pdf",), ("/r/RefA.xlsx",), ("/r/RefB.pdf",)], "path string")
    sizes = files.group_sizes(files.by_folder(one, "path"), "path")
    assert pairs(sizes, "group_key", "n_files") == [("RefA", 2), ("RefB", 1)]
    two = rows([("/r/RefA.pdf",), ("/s/RefA.xlsx",)], "path string")
    assert pairs(files.by_folder(two, "path"), "group_key") == [("r",), ("s",)]


# --- merge and checks

def test_classify(rows):
    schema = "product_code string, benefit_code string, sub_benefit_code string, diagnosis_code string, edi_code string"
    old = rows([("p", "b1", "s", "x", None), ("p", "b2", "s", "y", "e")], schema)
    new = rows([("p", "b1", "s", " x ", ""), ("p", "b2", "s", "z", "e"), ("p", "b3", "s", "n", "")], schema)
    out = merge.classify(old, new, fields=["diagnosis_code", "edi_code"])
    got = {r["benefit_code"]: (r["change_type"], [(c["field"], c["old"], c["new"]) for c in r["changes"]]) for r in out.collect()}
    assert got == {"b1": ("skip", []), "b2": ("update", [("diagnosis_code", "y", "z")]), "b3": ("insert", [])}


def test_row_errors_stop(rows):
    data = [("f", i, "" if i <= 25 else "p", "b") for i in range(1, 31)]
    df = rows(data, "file string, row_no long, product_code string, benefit_name string")
    assert quality.row_errors(df, "row_no", ["product_code", "benefit_name"], ["file"]).count() == 25
    out = quality.row_errors(df, "row_no", ["product_code", "benefit_name"], ["file"], 20)
    assert out.count() == 22 and out.filter(F.col("message") == names.OVERFLOW_MESSAGE).count() == 1
    assert pairs(quality.rows_read(df, out, "row_no", ["file"]), "file", "row_count") == [("f", 21)]
    assert pairs(quality.validity(df, out, "file"), "file", "error_count", "valid") == [("f", 22, False)]
    assert quality.header_message(["product_code"]).startswith("누락 컬럼: benefit_name, ")


def test_decisions(rows):
    queue = rows([(1, 10, "pending"), (2, 20, "pending"), (3, 30, "approved")], "id long, result_id long, status string")
    decisions = rows([
        (0, 1, "approve", "kim", None, "K1"), (1, 1, "reject", "lee", "late", None), (2, 2, "hold", "lee", None, None), (3, 2, "reject", "lee", "no", "K9"),
        (4, 3, "approve", "kim", None, None), (5, 9, "approve", "kim", None, None),
    ], "pos long, review_id long, action string, reviewer string, comment string, corrected_code string").withColumn("decided_at", F.timestamp_seconds("pos"))
    checked = review.check_decisions(decisions, queue)
    assert [r[1] for r in pairs(checked, "pos", "error")] == ["", "not pending", "unknown action", "", "not pending", "Review not found"]
    after = review.decided_queue(queue, checked.filter("error = ''"))
    assert pairs(after.na.fill("-"), "id", "status", "corrected_code") == [(1, "approved", "K1"), (2, "rejected", "-"), (3, "approved", "-")]
    results = rows([(10, "D", "review_needed"), (20, "D", "review_needed"), (40, "D", "auto_confirmed")], "id long, diagnosis_code string, verification_status string")
    assert pairs(review.apply_to_results(results, after), "id", "diagnosis_code", "verification_status") == [
        (10, "K1", "approved"), (20, "D", "rejected"), (40, "D", "auto_confirmed"),
    ]


# --- sources and projections

def test_header_fallback(rows):
    grid = rows([(0, "key", "지급률"), (1, "m1", "50")], "row_no long, c0 string, c1 string")
    out = src.promote_header(grid, 1, fallback_row=0, expect="지급률")
    assert out.columns == ["row_no", "key", "지급률"] and out.count() == 1


def test_drop_empty(rows):
    df = rows([("a", None, " "), (None, None, ""), ("b", None, None)], "x string, y string, z string")
    assert [tuple(r) for r in src.drop_empty(df).collect()] == [("a",), ("b",)]


def test_csv_encodings(spark, tmp_path):
    text = "코드\t이름\nZ1\t암진단비\n"
    for i, encoding in enumerate(["utf-8-sig", "utf-8", "utf-16", "cp949"]):
        folder = tmp_path / f"e{i}"
        folder.mkdir()
        (folder / "m.csv").write_bytes(text.encode(encoding))
        got = src.read_csv_guessing(spark, str(folder))
        assert got.columns == ["코드", "이름"] and [tuple(r) for r in got.collect()] == [("Z1", "암진단비")], encoding
    folder = tmp_path / "comma"
    folder.mkdir()
    (folder / "m.csv").write_text('a,b\n1,"x, y"\n')
    assert [tuple(r) for r in src.read_csv_guessing(spark, str(folder)).collect()] == [("1", "x, y")]


def test_mapping_lines(rows):
    lines = rows([(0, "대표담보코드\ta\tb\tc\td"), (1, " R1\t대표 \tZ1\t담보\t질병\tx"), (2, ""), (3, "short\tline")], "pos long, line string")
    out = src.reshape_mapping(lines, "line", "pos")
    assert pairs(out, "rep_code", "coverage_code", "rep_name", "coverage_name", "category", "check") == [("R1", "Z1", "대표", "담보", "질병", "")]


def test_wide_results(rows):
    df = rows([("b", "Inferred_EDI_Code", "E1", 1), ("b", "Inferred_Diagnosis_Code", None, 2)], "benefit_name string, attribute string, inferred_code string, pos int")
    wide = project.attribute_columns(df)
    assert [(r["edi_code"], r["diagnosis_code"]) for r in wide.collect()] == [("E1", None), (None, "")]
    one = project.benefit_rows(df, ["benefit_name"], "pos").first()
    assert (one["edi_code"], one["diagnosis_code"], one["coverage_period"]) == ("E1", None, None)


def test_risk_columns():
    assert project.find_risk_column(["ID", "신규위험률명", "위험률"]) == "신규위험률명"
    assert project.find_risk_column(["a", "b"]) == "a"
    assert project.find_id_column(["항목구분코드", "상품코드"]) == "상품코드"


def test_context(rows):
    from policyflow.operators.responses import attributes, context_text, mapping_context

    spark_rows = rows([(0, "1_진단분류코드.xlsx", "t0"), (1, "my_edi.xlsx", "t1"), (2, "진단분류표.csv", "t2")], "pos long, name string, content string")
    context = mapping_context(attributes(spark_rows.sparkSession), spark_rows, "name", "content", "pos")
    got = {}
    for r in context.orderBy("pos").collect():
        got.setdefault(r["attribute"], []).append(r["content"])
    assert got["Inferred_Diagnosis_Code"] == ["t0", "t2"] and got["Inferred_EDI_Code"] == ["t1"]
    assert got["Inferred_Min_Admission"] == [names.NO_MAPPING_TABLE] and got["Inferred_Accident_Type"][0].startswith("[주의]")
    texts = {r["attribute"]: r["context"] for r in context_text(context).collect()}
    assert len(got) == 9 and {k: "\n".join(v) for k, v in got.items()} == texts


def test_success_log(rows):
    df = rows([("별표1", 0, "A", True), ("별표1", 1, "B", False), ("별표1", 2, "C", True)], "name string, pos long, product string, ok boolean")
    row = assembly.success_log(df, ["name"], "product", F.col("ok"), "pos").first()
    assert (row["success_log"], row["failure_log"]) == (" A수정, C수정,", " B:해당별표없음,")


def test_csv_is_read_in_splits_where_records_end_with_lines(spark, tmp_path):
    plain, odd, cr = (tmp_path / n for n in ("plain", "odd", "cr"))
    for folder in (plain, odd, cr):
        folder.mkdir()
    lines = [f'{i},"a, ""b"" {i}",x{i}' for i in range(20_000)]
    (plain / "a.csv").write_text("\ufeffid,text,c\r\n" + "\r\n".join(lines) + "\r\n", encoding="utf-8", newline="")
    (odd / "a.csv").write_text('id,text\n1,"two\nlines"\n2,x\n', encoding="utf-8", newline="")
    (cr / "a.csv").write_text('id,text\n1,"a\rb"\n', encoding="utf-8", newline="")
    assert [src.needs_whole_files(spark, str(f)) for f in (plain, odd, cr)] == [False, True, True]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = src.read_csv_guessing(spark, str(plain))
        assert df.rdd.getNumPartitions() > 1
        assert sorted((int(r[0]), r[1], r[2]) for r in df.collect()) == [(i, f'a, "b" {i}', f"x{i}") for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in src.read_csv(spark, str(odd)).collect()] == [("1", "two\nlines"), ("2", "x")]
    told = src.told(spark, str(plain))
    assert told["UTF-8"] and not told["zeros"] and not told["goes_on"]
    (cr / "k.csv").write_bytes("코드,이름\n1,한글\n".encode("cp949"))
    assert not src.told(spark, str(cr / "k.csv"))["UTF-8"] and src.told(spark, str(cr / "k.csv"))["MS949"]
    assert [tuple(r) for r in src.read_csv_guessing(spark, str(cr / "k.csv")).collect()] == [("1", "한글")]
