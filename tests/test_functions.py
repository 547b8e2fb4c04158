import pytest
from notelith.functions import dates, numeric, order_codes
from notelith.functions import text as tx
from notelith.operators import numeric_audit, pages
from pyspark.sql import functions as F


def value(spark, column, **columns):
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()) or "x string"
    df = spark.createDataFrame([tuple(columns.values()) or ("",)], schema)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "f, x, want",
    [
        (tx.normalize_spaces, "  a \t b c\td ", "a b c\td"), (tx.fold_upper, "Albarán ñ straße", "ALBARAN N STRASSE"), (tx.ascii_only, "ñ€a", "na"),
        (tx.key_token, " ab-1/2 ", "AB12"), (tx.fix_glyphs, "1O5SB", "10558"), (tx.squash_doubles, "AABBC1", "ABC1"), (tx.strip_counter, "12: hola", "hola"),
        (tx.join_code_parts, "ALY 170610", "ALY170610"), (tx.strip_marks, "áÉç", "aEc"),
        (numeric.to_float_es, "1.234,56", 1234.56), (numeric.to_float_es, "12.50", 1250.0), (numeric.to_float_es, "3,5/C", 3.5), (numeric.to_float_es, "x", None),
        (numeric.to_num, "3,5", 3.5), (numeric.collapse_number, "1 234,5 -", "-1234,5"), (numeric.unit_factor, "/C", 100.0), (numeric.unit_factor, None, 1.0),
        (dates.parse_date_es, "el 3/2/25", "03/02/2025"), (dates.parse_date_es, "1/2/70", "01/02/1970"), (dates.parse_date_es, "2024-5-6", "06/05/2024"),
        (dates.parse_date_es, None, ""), (dates.date_of_code, "A110226/L", "11/02/2026"), (dates.date_of_code, "x", ""),
        (order_codes.clean, " /25.001-01/h- ", "25.001-01/H"), (order_codes.strip_noise, "A220126/L519325", "A220126/L"),
        (order_codes.strip_noise, "26.501/01/H519162", "26.501/01/H"), (order_codes.truncate, "A2600126/L-XX", "A2600126"),
        (order_codes.truncate, "25.62501/E", "25625/01"), (order_codes.truncate, "26.001/1", "26001/01"), (order_codes.truncate, "2600126", "26001/26"),
        (order_codes.truncate, "A/26O0126", "A2600126"), (order_codes.truncate, "pedido 12345/L", "12345/01"), (order_codes.truncate, "12345/678901", "12345"),
        (order_codes.truncate, "2.6.0.0.1.7", "26001"), (order_codes.truncate, None, ""), (order_codes.plausible, "26.501/01/H", True), (order_codes.plausible, "2/-01/01/H", False),
        (order_codes.truncate, "abc", ""), (order_codes.keep_suffix, "1110226/L", "A110226/L"), (order_codes.keep_suffix, "A110226L", "A110226/L"),
        (order_codes.keep_suffix, "1.83/8987", ""), (order_codes.keep_suffix, "26.501/04/H", "26.501/04/H"), (order_codes.looks_like_note, "AV 12345", True),
        (order_codes.looks_like_note, None, False), (order_codes.looks_like_date, "20240131", True), (order_codes.looks_like_phone, "943 123 456", True),
    ],
)
def test_scalars(spark, f, x, want):
    assert value(spark, f("x"), x=x) == want


def test_refusals(spark):
    rule = {"min_length": F.lit(5), "min_digits": F.lit(3), "require_alpha": F.lit(True), "allow_numeric": F.lit(False)}
    why = lambda x: value(spark, order_codes.refusals(F.col("x"), rule), x=x)
    assert why("A260126") == [] and why("A1") == ["short", "few_digits"] and why("123456") == ["no_letter", "bare_number"] and why("12.345") == ["no_letter"]


def test_first_matches(spark):
    p = [r"pedido ([0-9]+)", r"ref ([a-z]+)"]
    assert value(spark, tx.first_match("x", p), x="ref abc pedido 12") == "12"
    assert value(spark, tx.first_match_in_lines(tx.lines_of("x"), p), x="ref abc\npedido 12") == "abc"
    assert value(spark, tx.header_index(tx.lines_of("x"), ["CODIGO", "PRECIO"]), x="hola\n\nCódigo precio") == 1
    assert value(spark, tx.header_index(tx.lines_of("x"), ["CODIGO"]), x=None) is None
    assert value(spark, tx.decimals_in("x"), x="a 1,50 b -2.000,25 3") == ["1,50", "-2.000,25"]


def test_texts_merge(spark):
    assert value(spark, tx.merge_texts("a", "b"), a=" x ", b="y") == "x\ny" and value(spark, tx.merge_texts("a", "b"), a="axb", b="x") == "axb"
    assert value(spark, tx.union_lines("a", "b"), a="x\ny", b="y\r\nz") == ["x", "y", "z"]
    assert value(spark, tx.append_tokens("a", F.array(F.lit("b"), F.lit("c"))), a="c|a") == "c;a;b"
    assert value(spark, tx.repair_mojibake("a"), a="AlbarÃ¡n") == "Albarán" and value(spark, tx.repair_mojibake("a"), a="ñ€") == "ñ€"


def test_money(spark):
    assert value(spark, numeric.money_round("x"), x=2.675) == 2.68 and value(spark, numeric.money_round("x"), x=-0.125) == -0.13
    assert value(spark, numeric.calc_amount("q", "p", "d", "u"), q=3.0, p=10.0, d=5.0, u=100.0) == 0.29
    assert value(spark, numeric.effective_quantity("a", "b", "c"), a=0.0, b=-1.0, c=4.0) == 4.0
    best = value(spark, numeric.split_price_discount("x", "q", "a"), x="31075020", q=8.0, a=123.78)
    assert (best.price, best.discount) == (31.07, 50.2)
    assert value(spark, numeric.within("a", "b"), a=float("nan"), b=1.0) is False and value(spark, numeric.within("a", "b"), a=float("nan"), b=float("nan")) is True


def repair(spark, q, p, d, a, u=None):
    columns = dict(q=q, p=p, d=d, a=a, u=u)
    df = spark.createDataFrame([tuple(columns.values())], "q double, p double, d double, a double, u double")
    r = df.select(numeric_audit.repaired(*map(F.col, "qpdau")).alias("r")).first().r
    return r.q, r.p, r.d, r.a


def test_repair(spark):
    assert repair(spark, 41.0, 57.22, 73.56, 60.52)[0] == 4 and repair(spark, 41.0, 57.22, 73.56, 60.52)[3] == 60.52
    assert repair(spark, 4.0, None, 0.0, 10.0)[1] == 2.5 and repair(spark, None, 2.5, 0.0, 10.0)[0] == 4
    assert repair(spark, 4.0, 2.5, 0.0, None)[3] == 10 and repair(spark, 4.0, 5.0, None, 10.0)[2] == 50
    assert repair(spark, 400.0, 25.0, 0.0, 100.0, 100.0) == (400, 25, 0, 100)
    assert repair(spark, None, None, None, None) == (None, None, None, None)


def test_audit(spark):
    def tokens(q, p, d, a):
        df = spark.createDataFrame([(q, p, d, a)], "q double, p double, d double, a double")
        return df.select(numeric_audit.audit_tokens(*map(F.col, "qpda")).alias("t")).first().t

    assert tokens(2.0, 5.0, 0.0, 10.0) == [] and tokens(2.0, 5.0, 0.0, 11.0) == ["importe_formula"] and tokens(2.0, 5.0, 10.0, None) == ["importe_hint=9.00"]
    assert tokens(2.0, 5.0, None, 8.0) == ["discount_hint=20.00"] and tokens(1.0, 1.0, 120.0, -1.0) == ["importe_negativo", "discount_overflow", "discount_recheck"]


def test_page_metrics(spark):
    assert value(spark, pages.entropy("x"), x="aabb") == pytest.approx(1.0) and value(spark, pages.entropy("x"), x=None) == 0 and value(spark, pages.entropy("x"), x=" \n") == 0
    assert value(spark, pages.footer_only("x", ["CODIGO"], ["TOTAL", "IMPORTE"]), x="total\nimporte") is True
    assert value(spark, pages.sheet_of("x")["sheets"], x="Hoja 2 de 3") == 3


def test_rules(spark):
    rules = spark.createDataFrame([("A", 3, 0, False, True, True, False, False), ("B", 5, 3, True, False, False, True, False), ("C", 3, 0, False, True, False, True, True)], order_codes.RULE_SCHEMA)
    rows = spark.createDataFrame([(1, "A", "12-x"), (2, "B", "26.001/01"), (3, "Z", "123"), (4, "C", "126001"), (5, None, "26.001/01/H519"), (6, "Z", None)], "i int, s string, c string")
    found = {r.i: r.n for r in order_codes.normalize(rows, "c", "s", rules, "n").collect()}
    assert found == {1: "12-X", 2: "", 3: "", 4: "26001", 5: "26.001/01/H", 6: ""}
