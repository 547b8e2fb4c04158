import numpy as np
import pytest
from notelith.operators import units
from pyspark.sql import functions as F

SCHEMA = "rec_id long, Fuente string, AlbaranNumero string, Codigo string, Proveedor string, Descripcion string, CantidadServida string, UnidadMedida string, UnidadesPor string, PrecioUnitario string, recorded_at timestamp_ntz, note string, code int, base string, part string"


def frame(spark, rows):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    full = [(i, "s", n, c, "p", d, q, u, per, price, t + datetime.timedelta(days=i), "n", 1, "b", "p") for i, (n, c, d, q, u, per, price) in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA)


def converted(spark, rows):
    return {r.rec_id: (r.quantity, r.price, r.base) for r in units.common_units(frame(spark, rows)).collect()}


def pairs(spark, rows):
    return {tuple(r) for r in units.equal_pairs(units.common_units(frame(spark, rows))).collect()}


READINGS = [
    (("Cable", "1.300,00", "mt.", "C", "76,25"), (1300, 0.7625, "m")),
    (("Cable (cant. en mm)", "2993000", None, "10", "0,4053 cént."), (2993, 0.4053, "m")),
    (("Cinta", "119.72", None, "1", "10,13 €/rollo de 25 m"), (2993, 0.4052, "m")),
    (("Perfil", "0,12bobina 0,5 km", None, None, "516.30"), (60, 1.0326, "m")),
    (("Taco", "13,5", None, None, "85.05 eur por cto."), (1350, 0.8505, "ud")),
    (("Terminal", "450 ud", None, None, "625,8 €/ 100 uds."), (450, 6.258, "ud")),
    (("Remache", "200", "par", "1000", "879"), (400, 0.4395, "ud")),
    (("Barniz", "1,25", "m³", "M", "532,500.00"), (1250, 0.5325, "l")),
    (("Aceite servido por L", "12", None, None, "0,5150 por 10"), (12, 0.0515, "l")),
    (("Arandela", "3caja de 50", None, None, "20.70"), (150, 0.414, "ud")),
    (("Saco", "0,84", "saco 25kg", "/D", "5663 céntimos"), (21, 0.226520, "kg")),
    (("Sin unidad", "-2", None, "raro", "1"), (-2, 1, None)),
]


@pytest.fixture(scope="module")
def readings(spark):
    return converted(spark, [("n", f"c{i}", *row) for i, (row, _) in enumerate(READINGS)])


@pytest.mark.parametrize("i", range(len(READINGS)))
def test_reading(readings, i):
    want = READINGS[i][1]
    q, p, base = readings[i + 1]
    assert (q, p, base) == (pytest.approx(want[0]), pytest.approx(want[1], rel=1e-3), want[2])


def test_missing_and_empty(spark):
    rows = [("n", "c", None, None, None, None, None), ("n", "c", "", "", " ", "", "x"), (None, None, "d", "5 m", None, None, "1"), (None, None, "d", "5 m", None, None, "1"), ("n", "c", "d" * 300_000, "5 m", None, "0", "0")]
    found = converted(spark, rows)
    assert found[1][:2] == found[2][:2] == (None, None) and found[3] == (5, 1, "m") and found[5][:2] == (5, 0)
    assert pairs(spark, rows) == set()
    assert units.common_units(frame(spark, rows).where("false")).collect() == []


def test_units_of_a_line_fill_in(spark):
    assert converted(spark, [("n", "c", "d", "5", None, None, "1"), ("n", "c", "d", "5 kg", None, None, "1")])[1] == (5, 1, "kg")


def test_unreadable_unit_is_decoded_from_the_level(spark):
    rows = [("n", "c", "d", "5 m", None, None, "2"), ("n", "c", "d", "5000", "bx", None, "0,002"), ("n", "c", "d", "5,01 m", None, None, "2"), ("n", "d", "d", "7000", None, None, "1")]
    found = converted(spark, rows)
    assert found[2][:2] == (pytest.approx(5), pytest.approx(2)) and found[4][:2] == (7000, 1)


def path_cost(path, logs, emission):
    f = np.log(units.STATES)
    total = sum(emission[i, s] for i, s in enumerate(path))
    for i in range(1, len(path)):
        for v, sign in zip(logs, (1, -1), strict=True):
            jump = v[i] - v[i - 1] + sign * (f[path[i]] - f[path[i - 1]])
            total += 0 if np.isnan(jump) else min(jump**2 / (2 * units.LEVEL_SPREAD**2), units.MAX_JUMP_COST)
    return total


def random_series(r, n):
    logs = [r.choice(np.log(units.STATES), n) + r.normal(0, 0.03, n) for _ in range(2)]
    logs[0][r.random(n) < 0.2] = np.nan
    at, named = np.arange(units.STATES.size), r.integers(0, units.STATES.size, n)
    emission = np.where(at == named[:, None], 0.0, np.where(r.random(n)[:, None] < 0.6, units.UNREADABLE_COST, units.READ_COST))
    return logs, emission


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(15):
        logs, emission = random_series(r, 4)
        state, _, _ = units.viterbi(logs, emission, np.array([True, False, False, False]))
        assert path_cost(state, logs, emission) == pytest.approx(min(path_cost(p, logs, emission) for p in itertools.product(range(units.STATES.size), repeat=4)))


def test_a_read_unit_gives_way_to_both_neighbours_only(spark):
    one, odd = ("n", "c", "d", "5 m", None, None, "2"), ("n", "c", "d", "5 mm", None, None, "2")
    assert converted(spark, [one, odd, one])[2][0] == pytest.approx(5)
    assert converted(spark, [one, odd])[2][0] == pytest.approx(0.005)
    assert converted(spark, [one, ("n", "c", "d", "5 mm", None, None, "7"), one])[2][0] == pytest.approx(0.005)


def test_masked_units_are_recovered(spark):
    """The named units of a fifth of the records are made unreadable: the levels of their lines give them back."""
    from notelith.runtime import table

    records = table(spark, "/root/testdata/sf0.01", "qty_records")
    read = units.read_records(records).select("rec_id", "note", "code", "unit_factor", F.col("base").isNotNull().alias("named"))
    base = F.regexp_extract("CantidadServida", r"^\s*([-+]?[0-9][0-9.,]*)", 1)
    price = F.regexp_replace("PrecioUnitario", r"/.*|por .*", "")
    hidden = F.pmod(F.xxhash64("rec_id"), F.lit(5)) == 0
    masked = records.withColumns(
        {
            "CantidadServida": F.when(hidden, F.concat(base, F.lit(" xx"))).otherwise(F.col("CantidadServida")),
            "UnidadMedida": F.when(hidden, F.lit(None)).otherwise(F.col("UnidadMedida")),
            "Descripcion": F.when(hidden, F.lit("")).otherwise(F.col("Descripcion")),
            "PrecioUnitario": F.when(hidden, price).otherwise(F.col("PrecioUnitario")),
        }
    )
    plain = units.common_units(records, of_line=False).select("rec_id", "note", "code", F.col("quantity").alias("q"), F.col("price").alias("p"))
    known = plain.join(read.select("rec_id", "named"), "rec_id").where("q > 0 and p > 0").toPandas()
    found = {r.rec_id: (r.quantity, r.price) for r in units.common_units(masked, of_line=False).collect()}
    gone = {r.rec_id for r in records.where(hidden).select("rec_id").collect()}
    raw = {r.rec_id: r for r in units.read_records(masked).collect()}
    seen = [g for _, g in known.groupby(["note", "code"])]
    cases = right = 0
    for g in seen:
        rest = [r for r in g.itertuples() if r.rec_id not in gone]
        for r in g.itertuples():
            mates = [m for m in rest if abs(m.q / r.q - 1) < 0.01 and abs(m.p / r.p - 1) < 0.01]
            moved = [s for s in units.STATES if raw[r.rec_id].quantity and abs(raw[r.rec_id].quantity * s / r.q - 1) < 0.001]
            priced = [s for s in moved if raw[r.rec_id].price and abs(raw[r.rec_id].price / s / r.p - 1) < 0.01]
            if r.rec_id in gone and r.named and mates and priced and len(mates) == len(rest):  # it can be told from its line
                cases += 1
                right += abs(found[r.rec_id][0] / r.q - 1) < 0.001
    assert cases > 40 and right >= 0.9 * cases


def test_pairs_against_brute_force(spark):
    r = np.random.default_rng(2)
    n = 400
    q, p = np.exp(r.normal(0, 0.02, n)) * r.choice([1, -1, 100, 0], n), np.exp(r.normal(0, 0.02, n))
    key = r.choice(["hot", "hot", "a", "b"], n)
    records = spark.createDataFrame([(i, str(key[i]), "c", float(q[i]), float(p[i])) for i in range(n)], "rec_id long, note string, code string, quantity double, price double")
    near = lambda x, y: abs(x - y) <= 0.005 * max(abs(x), abs(y))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and near(q[i], q[j]) and near(p[i], p[j])}
    found = [tuple(x) for x in units.equal_pairs(records).collect()]
    assert set(found) == want and len(found) == len(want)


def test_a_series_over_many_ranges_is_decoded_as_one(spark, monkeypatch):
    monkeypatch.setattr(units, "LONG", 300)
    r = np.random.default_rng(3)
    n, names = 3000, ["m", "mm", "cm", "??", "hl", "km"]
    rows = [("hot" if i % 10 else f"x{i % 70}", "c", "d", f"{r.choice(units.STATES) * r.normal(5, 0.1):.5f} {r.choice(names)}", None, None, f"{r.choice(units.STATES):.4f}") for i in range(n)]
    records = frame(spark, rows).repartition(7)
    found = {x.rec_id: x.quantity for x in units.common_units(records).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        again = {x.rec_id: x.quantity for x in units.common_units(records).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = units.read_records(records).orderBy("note", "code", "at", "rec_id").drop("at").toArrow()
    s = units.Series(t)
    state, _, _ = units.viterbi(s.logs, s.emission(), s.first)
    want = dict(zip(t["rec_id"].to_pylist(), s.converted(state)[0], strict=True))
    assert len(found) == len(again) == n and found.keys() == want.keys()
    costs = lambda got: [path_cost([int(np.abs(np.log(units.STATES * s.quantity[i] * s.quantity_factor[i] / units.STATES[s.named[i]] / got[x])).argmin()) for i, x in part], [v[[i for i, _ in part]] for v in s.logs], s.emission()[[i for i, _ in part]]) for part in [list(enumerate(t["rec_id"].to_pylist()))[: int(np.flatnonzero(s.first)[1])]]]
    assert costs(found) == pytest.approx(costs(want)) and costs(again) == pytest.approx(costs(want))
    assert sum(abs(found[i] - want[i]) > 1e-9 for i in want) <= 3 and (state != s.named).sum() > 100


def test_a_long_line_decodes_as_its_short_form(spark):
    """100,001 records of one line: every third unreadable, as in a line of three."""
    few = [("n", "c", "d", "5 m", None, None, "2"), ("n", "c", "d", "5000", "bx", None, "0,002"), ("n", "c", "d", "5,01 m", None, None, "2")]
    short = converted(spark, few)
    base = frame(spark, few)
    many = spark.range(100_001).select((F.col("id") % 3 + 1).alias("rec_id"), F.col("id")).join(base, "rec_id").withColumn("rec_id", F.col("id") + 1)
    many = many.withColumn("recorded_at", F.timestamp_seconds(F.col("id")).cast("timestamp_ntz")).drop("id")
    found = units.common_units(many, of_line=False).groupBy((F.col("rec_id") - 1) % 3).agg(F.min("quantity").alias("a"), F.max("quantity").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 100_001
    for r in found:
        assert r.a == r.b == pytest.approx(short[r[0] + 1][0])
