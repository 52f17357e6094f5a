import pytest
from pyspark.sql import functions as F

from almoneda.functions import scalar as S


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("sid,want", [("19862167", "2789050c-cde3-577f-baea-1cc84af2eaf0")])
def test_object_uuid(spark, sid, want):
    import uuid

    assert value(spark, S.object_uuid("x"), x=sid) == want
    for s in ("1", "é", "", "42/7"):
        assert value(spark, S.object_uuid("x"), x=s) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://placsp.id/" + s))


@pytest.mark.parametrize("text,want", [("1908-10-30Z", "1908-10-30T00:00:00Z"), ("2020-05-01", "2020-05-01T00:00:00Z"), ("2020-05-01T09:30:00Z", "2020-05-01T09:30:00Z"), ("2020-05-01T09:30:00+02:00", "2020-05-01T09:30:00+02:00"), ("no-es-fecha", None), (None, None)])
def test_dates(spark, text, want):
    assert value(spark, S.normalize_date(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [(" b-72.318.934 ", "B72318934"), ("", None), (None, None)])
def test_nif(spark, text, want):
    assert value(spark, S.normalize_nif(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("Hermanos Oliva Bahia, S.L.L.", "HERMANOS OLIVA BAHIA"), ("HERMANOS OLIVA BAHIA SLL", "HERMANOS OLIVA BAHIA"), ("Acme S.A.", "ACME"), ("S.L.", "SL"), ("I B M España", "IBM ESPAÑA"), ("", None), (None, None)])
def test_names(spark, text, want):
    assert value(spark, S.normalize_name(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("name,nif,want", [("UTE LIMPIEZA 2025", "U12345678", True), ("UTE Algo", "B12345678", True), ("Acme SL", "B12345678", False), (None, None, False)])
def test_ute(spark, name, nif, want):
    assert value(spark, S.is_ute(F.lit(name).cast("string"), F.lit(nif).cast("string"))) is want


@pytest.mark.parametrize("hour,want", [(23, True), (12, False), (22, True), (7, False)])
def test_offpeak(spark, hour, want):
    assert value(spark, S.is_offpeak(F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp"))) is want


@pytest.mark.parametrize("code,level", [("45000000", 2), ("45200000", 3), ("45210000", 4), ("45211000", 5), ("45211000-1", 5)])
def test_cpv_level(spark, code, level):
    assert value(spark, S.cpv_level("x"), x=code) == level


@pytest.mark.parametrize("code,stem", [("45", "45"), ("45-1", "451"), ("03110000", "0311"), ("45211000-1", "45211")])
def test_cpv_prefix(spark, code, stem):
    assert value(spark, S.cpv_prefix("x"), x=code) == stem


@pytest.mark.parametrize("amount,bucket", [(None, None), (0.0, None), (-1.0, None), (999.99, "b00"), (1000.0, "b00"), (1e8, "b14"), (5e9, "b14"), (1e5, "b06")])
def test_budget_bucket(spark, amount, bucket):
    assert value(spark, S.budget_bucket(F.lit(amount).cast("double"))) == bucket


def test_scales(spark):
    pos = lambda v: value(spark, S.log_scale_pos(F.lit(v).cast("double")))
    assert [round(pos(v), 9) for v in (1e3, 1e8, 100.0, 1e12, None)] == [0, 1, 0, 1, 0]
    assert value(spark, S.linear_pos(F.lit(50.0), F.lit(0.0), F.lit(100.0))) == 0.5
    for v in (5_000.0, 123_456.0, 9e7):
        assert abs(value(spark, S.log_scale_value(S.log_scale_pos(F.lit(v)))) - v) / v < 0.01


@pytest.mark.parametrize("text,want", [("Importe: 1.234,56 EUR", 1234.56), ("5 %", 5.0), ("nada", None), ("..,", None)])
def test_spanish_number(spark, text, want):
    assert value(spark, S.spanish_number("x"), x=text) == want


def test_fences_and_links(spark):
    assert value(spark, S.strip_fences("x"), x='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert [value(spark, S.link_kind("x"), x=n) for n in ("Pliego Administrativo", "PPT v2", "Pliego Técnico", "Anexo")] == ["PCAP", "PPT", "PPT", None]
    assert S.query_string({"q": "a b", "cpv": ["45", "03"], "k": None, "open": True}) == "q=a%20b&cpv=45&cpv=03&open=true"
