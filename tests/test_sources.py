import pytest
from pyspark.sql import functions as F

from comarca.operators.measures import indicator
from comarca.plans.jobs import load, run_indicator, run_unit_indicator
from comarca.sources import tables as src
from comarca.sources.dictionaries import read_catalogue, read_docs
from comarca.sources.geometry import (
    area_features, read_area_features, read_unit_geometry, unit_geometry_path,
)
from comarca.sources.sinks import write_partitioned_by_department
from comarca.spec import IndicatorSpec


def test_paths():
    assert src.dataset_paths("/b", 2024, "personas", "3") == ["/b/2024/persona_dep03.parquet"]
    assert len(src.dataset_paths("/b", 2024, "personas")) == 9
    assert src.dataset_paths("/b", 1976, "personas") == ["/b/1976/poblacion.parquet"]
    assert src.dataset_paths("/b", 2024, "fichas") == ["/b/fichas/ficha.parquet"]
    with pytest.raises(ValueError):
        src.dataset_paths("/b", 2012, "mortalidad")
    assert [k for _, k in src.available_tables(2001)] == ["personas", "viviendas"]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "IDEP int, iprov int, Mun int, "
                               "x_REF_ID int, p26_edad int")
    geo = src.GeoColumns.of(df)
    assert (geo.department, geo.province, geo.municipality) == ("IDEP", "iprov", "Mun")
    assert src.analysis_columns(df) == ["p26_edad"]
    assert src.available_levels(df, 2024, "personas") == ["departamento", "municipio"]
    assert src.available_levels(df, 1976, "personas") == ["departamento"]
    assert src.available_levels(df, 2024, "fichas") == ["unidad"]
    with pytest.raises(ValueError):
        src.resolve_columns(df, {"v": ("nada",)}, required=["v"])


@pytest.fixture()
def census(spark, tmp_path):
    base = str(tmp_path)
    for dep in range(1, 10):
        rows = [(dep, 1, m, a) for m in (1, 2) for a in range(dep)]
        kind = "idep int, iprov int, imun int, p26_edad int"
        df = spark.createDataFrame(rows, kind)
        if dep == 9:
            df = df.withColumn("extra", F.lit("x"))       # files may differ in columns
        df.write.parquet(f"{base}/2024/persona_dep{dep:02d}.parquet")
    return base


def test_parts_are_one_relation_and_prune(spark, census):
    spec = IndicatorSpec(year=2024, table="personas")
    whole = load(spark, census, spec)
    assert "extra" in whole.columns
    got = {r.geo_code: r.casos for r in indicator(whole, spec).collect()}
    assert got == {f"{d:02d}": 2 * d for d in range(1, 10)}
    one = load(spark, census, IndicatorSpec("municipio", municipality="030102",
                                            year=2024, table="personas"))
    assert one.select("idep").distinct().collect()[0][0] == 3
    assert one.count() == 6


def test_department_from_file_name(spark, census):
    paths = src.dataset_paths(census, 2024, "personas")
    rows = spark.read.parquet(*[p + "/*.parquet" for p in paths[:3]])
    named = src.with_department_from_file(
        rows.drop("idep").withColumn("v", F.lit(1)), "dep", r"part-0*(\d+)")
    assert set(r[0] for r in named.select(F.length("dep")).collect()) == {2}
    with pytest.raises(ValueError):
        src.with_department_from_file(rows, universe=F.lit(True))


def test_partitioned_copy_prunes_folders(spark, tmp_path):
    rows = spark.createDataFrame([("01", 5), ("2", 6), ("02", 7)], "idep string, v int")
    path = str(tmp_path / "copy")
    write_partitioned_by_department(rows, path)
    back = spark.read.parquet(path).filter("idep = 2")
    assert sorted(r.v for r in back.collect()) == [6, 7]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(idep" in plan


def test_csv_dictionaries(spark, tmp_path):
    cat = tmp_path / "cat.csv"
    cat.write_text('tabla,variable,etiqueta,bloque,tipo,expr,denominador\n'
                   'fichas,a_h,"Con ""comillas"", hombres",b1,numerica,a_h,tot_h\n'
                   'unidades,ficha,Ficha,b2,numerica,CASE WHEN ficha THEN 1 ELSE 0 END,1\n',
                   encoding="utf-8")
    rows = read_catalogue(spark, str(cat), "fichas").collect()
    assert len(rows) == 1 and rows[0].etiqueta == 'Con "comillas", hombres'
    assert rows[0].bloque_etiqueta is None
    docs = tmp_path / "docs.csv"
    docs.write_text("anio,tabla,variable,definicion,pregunta_literal,universo_literal,"
                    "regla_derivacion\n2024,persona,p1,,1. ¿Qué?,,\nx,persona,p2,,,,\n",
                    encoding="utf-8")
    rows = read_docs(spark, str(docs)).collect()
    assert [(r.anio, r.variable, r.definicion) for r in rows] == [(2024, "p1", "")]


GEOJSON = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"idep": "1", "iprov": 2, "imun": "03",
   "nombre_mun": "Uno", "superficie_km2": 10.5},
  "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}},
 {"type": "Feature", "properties": {"idep": "01", "iprov": "02", "imun": "04",
   "nombre_mun": "", "superficie_km2": null}, "geometry": null}]}"""


def test_geojson_collection(spark, tmp_path):
    path = tmp_path / "areas.geojson"
    path.write_text(GEOJSON, encoding="utf-8")
    rows = read_area_features(spark, str(path), "municipio", whole_file=True).orderBy(
        "geo_code").collect()
    assert [(r.geo_code, r.geo_nombre, r.superficie_km2) for r in rows] == \
        [("010203", "Uno", 10.5), ("010204", None, None)]
    assert rows[0].geometria.startswith('{"coordinates":[[[[0,0]')
    dep = read_area_features(spark, str(path), "departamento", whole_file=True)
    assert {r.geo_code for r in dep.collect()} == {"01"}


def test_collections_are_cut_into_features_by_byte_ranges(spark, tmp_path):
    import json
    folder, rows = tmp_path / "many", []
    folder.mkdir()

    def feature(i, sep):
        name = f'Nombre {i} é " {{"type":"Feature", \\ ]}},' + "x" * (i % 700)
        rows.append((f"{i:06d}", name))
        return (f'{{{sep}"type":{sep}"Feature",{sep}"properties":{{"idep":"{i // 10000}","iprov":"{i // 100 % 100}","imun":"{i % 100}",'
                f'"nombre_mun":{json.dumps(name)}}},\n"geometry":{{"type":"Polygon","coordinates":[[[0,{i}],[1,1],[0,{i}]]]}}}}')
    one = [feature(i, " ") for i in range(1, 4000)]
    one[77] = feature(78, "")          # another spacing than the others
    rows.remove(rows[77])
    (folder / "a.geojson").write_text('{"type": "FeatureCollection", "name": "x",\n"features": [\n' + ",\n".join(one) + '\n], "bbox": [1, 2]}\n', encoding="utf-8")
    two = [feature(i, "") for i in range(4000, 4100)]
    (folder / "b.geojson").write_text('{"features":[' + ",".join(two) + ']}', encoding="utf-8")
    last = '{"properties":{"idep":"9","iprov":"9","imun":"9","nombre_mun":"n"},"type":"Feature","geometry":null}'
    (folder / "c.geojson").write_text('{"type":"FeatureCollection","features":[' + last + "]}", encoding="utf-8")
    (folder / "d.geojson").write_text('{"type":"FeatureCollection","features":[]}', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = read_area_features(spark, str(folder), "municipio", collection=True)
        assert found.rdd.getNumPartitions() > 10
        got = sorted((r.geo_code, r.geo_nombre) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*rows, ("090909", "n")])
    (folder / "e.geojson").write_text('{"features":[' + feature(1, "") + "," + feature(2, "")[:-30], encoding="utf-8")
    with pytest.raises(Exception):
        read_area_features(spark, str(folder / "e.geojson"), "municipio", collection=True).collect()
    with pytest.raises(FileNotFoundError):
        read_area_features(spark, str(folder / "none.geojson"), "municipio", collection=True)


def test_unit_geometry_files(spark, tmp_path):
    assert unit_geometry_path("/b", "rural", 3) == "/b/fichas/geo_comunidad.parquet"
    rows = [("00255-A", None, bytearray(b"\x01\x02"), "03", "01", "01"),
            ("00256-A", "Z", bytearray(b"\x03"), "03", "01", "02")]
    spark.createDataFrame(rows, "codigo string, nombre string, geometria binary, "
                          "idep string, iprov string, imun string").write.parquet(
        unit_geometry_path(str(tmp_path), "urbana", 3))
    got = read_unit_geometry(spark, str(tmp_path), "030101", "urbana").collect()
    assert [(r.codigo, r.nombre, bytes(r.geometria)) for r in got] == \
        [("00255-A", "", b"\x01\x02")]


def test_indicator_job_writes_every_area(spark, census, tmp_path):
    lines = "\n".join(
        '{"type":"Feature","properties":{"idep":"%d","nombre_dep":"D%d"},'
        '"geometry":{"type":"Point","coordinates":[%d,0]}}' % (d, d, d)
        for d in (1, 2, 77))
    text = spark.createDataFrame([(v,) for v in lines.split("\n")], "value string")
    spec = IndicatorSpec(measure="mean", variable="p26_edad", year=2024, table="personas")
    path = run_indicator(spark, census, spec, area_features(text, "departamento"),
                         str(tmp_path / "out"))
    assert "/personas-2024-departamento-p26_edad-mean-" in path
    from comarca.sources.geometry import parse_features
    back = parse_features(spark.read.text(path)).selectExpr(
        "variant_get(propiedades, '$.geo_code', 'string') AS code",
        "variant_get(propiedades, '$.nombre_geo', 'string') AS name",
        "try_variant_get(propiedades, '$.valor_censo', 'double') AS v").collect()
    assert {(r.code, r.name, r.v) for r in back} == \
        {("01", "Chuquisaca", 0.0), ("02", "La Paz", 0.5), ("77", "D77", None)}


def test_unit_job_writes_by_area(spark, tmp_path):
    base = str(tmp_path)
    rows = [("u1", 3, 1, 1, 1, 4, 10), ("u2", 3, 1, 1, 2, 0, 0), ("u3", 3, 1, 2, 1, 5, 5)]
    spark.createDataFrame(rows, "codigo string, idep int, iprov int, imun int, area int, "
                          "agua int, total int").write.parquet(f"{base}/fichas/ficha.parquet")
    units = spark.createDataFrame(
        [("u1", "n1", "urbana", bytearray(b"1")), ("u2", "n2", "rural", bytearray(b"2")),
         ("u9", "n9", "urbana", bytearray(b"9")), ("u8", "n8", "urbana", None)],
        "codigo string, nombre string, area string, geometria binary")
    spec = IndicatorSpec("unidad", "porcentaje", "agua", municipality="030101",
                         year=2024, table="fichas")
    path = run_unit_indicator(spark, base, spec, "agua", "total", units, f"{base}/out")
    back = spark.read.parquet(path)
    got = {(r.codigo, r.area, r.valor_censo, r.casos_censo) for r in back.collect()}
    assert got == {("u1", "Urbana", 40.0, 10.0), ("u2", "Rural", None, 0.0),
                   ("u9", "Urbana", None, None)}
    with pytest.raises(ValueError):
        run_unit_indicator(spark, base, IndicatorSpec("unidad", "total", "agua", year=2024,
                           table="fichas"), "agua", None, units, f"{base}/out2")


def test_department_files_are_of_bounded_size(spark, tmp_path):
    from comarca.sources.sinks import write_partitioned_by_department
    df = spark.range(0, 9000, 1, 8).select(F.when(F.col("id") % 3 > 0, "07").when(F.col("id") % 9 > 0, "1").otherwise(None).alias("idep"),
                                           (F.col("id") % 50).cast("string").alias("iprov"), "id")
    write_partitioned_by_department(df, str(tmp_path / "out"), rows_per_file=1000)
    files = {p.name: [spark.read.parquet(str(f)).count() for f in p.glob("*.parquet")] for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert set(files) == {"idep=7", "idep=1", "idep=__HIVE_DEFAULT_PARTITION__"}
    assert max(n for ns in files.values() for n in ns) <= 1000
    assert 6 <= len(files["idep=7"]) <= 12 and len(files["idep=1"]) <= 4 and len(files["idep=__HIVE_DEFAULT_PARTITION__"]) == 1
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 9000 and back.select("id").distinct().count() == 9000 and dict(back.dtypes)["iprov"] == "int"
    one = spark.read.parquet(str(next((tmp_path / "out" / "idep=7").glob("*.parquet")))).select("iprov").collect()
    assert [r.iprov for r in one] == sorted(r.iprov for r in one)
