from notelith.llm import confusables as cf

FIELDS = ["Codigo", "Descripcion"]


def test_looks_the_same():
    for a, b in [
        ("Cinta", "Ｃｉｎｔａ"), ("óptica", "óptica"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"),
        ("AB-1", "АВ‑1"), ("señal", "señal"), ("µF", "μF"), ("Ω", "Ω"), ("flex", "ﬂex".replace("ﬂ", "fl")), ("caro", "саrо"),
        ("Cable", "𝐂𝒶𝔟𝕝𝖾"), ("B12", "𝐁𝟏𝟐"), ("カタ", "ｶﾀ"), ("TUBO", "ᎢUᏴO"), ("LED", "ꓡꓰꓓ"), ("MOTOR", "ⲘⲞⲦⲞR"), ("caro", "cɑrᴏ"),
        ("ab", "aㅤb"), ("ab", "a\ufe0fb"), ("a b", "a⠀b"), ("ab", "a\U000e0101b"), ("ó", "𝐨́"), ("А", "𝐀"),
    ]:
        assert cf.skeleton_of(a) == cf.skeleton_of(b), (a, b)


def test_visible_differences_stay():
    for a, b in [("O", "0"), ("l", "1"), ("I", "l"), ("a", "A"), ("a b", "a  b"), ("optica", "óptica"), ("m²", "m2"), ("½", "1/2"), ("a-b", "a–b"), ("a.b", "a,b"), ("Ω", "ω"), ("a b", "a\tb")]:
        assert cf.skeleton_of(a) != cf.skeleton_of(b), (a, b)


def test_skeleton_is_stable():
    for x in ["", "Ｃｉｎｔａ ó", "á​", "ЕхΑ", "😀漢"]:
        assert cf.skeleton_of(cf.skeleton_of(x)) == cf.skeleton_of(x)
    assert cf.skeleton_of(None) is None


def frames(spark):
    schema = "line_id long, Codigo string, Descripcion string, a string, b string, s0 string, art_id string"
    lines = spark.createDataFrame(
        [
            (1, "AB-1", "Cinta óptica"), (2, "АВ‑1", "Cinta óptica"), (3, "AB-1", "Cinta optica"), (4, "AB-1", "Ｃinta óptica"), (5, None, "Cinta óptica"),
            (6, "AB-1", None), (7, "", ""), (8, "AB-1", "Ｃinta óptica"), (9, "AB-1", "cinta óptica"),
        ],
        "line_id long, Codigo string, Descripcion string",
    ).selectExpr("*", "'x' a", "'y' b", "'z' s0", "'w' art_id")
    assert [f.split()[0] for f in schema.split(", ")] == lines.columns
    articles = spark.createDataFrame([(10, "AB-1", "Cinta óptica", "q"), (11, "AB-1", "Cinta óptica", "q"), (12, None, "x", "q")], "art_id long, Codigo string, Descripcion string, line_id string")
    return lines, articles


def test_found_with_ties_nulls_and_clashing_columns(spark):
    found = sorted(tuple(r) for r in cf.look_alikes(*frames(spark), "line_id", "art_id", FIELDS).collect())
    assert found == [(x, y) for x in (2, 4, 8) for y in (10, 11)]


def test_one_form_and_groups(spark):
    lines, articles = frames(spark)
    form = {r.line_id: (r.Codigo, r.Descripcion) for r in cf.one_form(lines, articles, "line_id", FIELDS).collect()}
    assert form[2] == form[4] == ("AB-1", "Cinta óptica") and form[9][1] == "cinta óptica" and form[5] == (None, "Cinta óptica") and len(form) == 9
    groups = cf.groups_of_forms(lines, "Descripcion").collect()
    assert [(r.forms, r.records) for r in groups] == [(3, 5)]


def test_empty_tables_and_long_text(spark):
    lines, articles = frames(spark)
    for a, b in ((lines.where("false"), articles), (lines, articles.where("false"))):
        assert cf.look_alikes(a, b, "line_id", "art_id", FIELDS).collect() == []
    assert cf.one_form(lines, articles.where("false"), "line_id", FIELDS).count() == 9
    assert cf.skeleton_of("а" * 1_000_000) == "a" * 1_000_000
