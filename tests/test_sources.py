import pytest
from pyspark.sql import functions as F

from etalage import vocab
from etalage.plans import cleaning, compare, kpi
from etalage.sources import mart, snapshots, versions
from etalage.sources import retail_star as star
from etalage.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_csv_source(spark, tmp_path):
    folder = tmp_path / "auchan"
    folder.mkdir()
    (folder / "a.csv").write_bytes(
        "﻿nom_produit,categorie,prix,magasin,date_scraping,url_produit,autre\n"
        '"Riz ""long"" 1kg",NA,1000,Auchan,2024-01-10,/1,x\n'
        ",Epicerie,nan,Auchan,2024-01-10,/2,x\n".encode()
    )
    df = snapshots.read_source(spark, str(folder), fmt="csv")
    assert tuple(df.columns) == vocab.RAW_COLUMNS
    rows = cleaning.coerce_required(df).collect()
    assert [(r.nom_produit, r.categorie, r.prix) for r in rows] == [('Riz "long" 1kg', None, 1000.0)]
    assert snapshots.read_source(spark, str(folder), (*vocab.RAW_COLUMNS, "stock"), "csv") is None


def test_latest_files(spark, tmp_path):
    import time

    root = tmp_path / "run_progress"
    spark.range(3).repartition(2).write.parquet(str(root / "auchan_1"))
    spark.range(9).write.parquet(str(root / "sakanal_1"))
    time.sleep(1.1)
    spark.range(5).repartition(3).write.parquet(str(root / "auchan_2"))
    spark.range(7).write.parquet(str(root / "auchan_3_progress"))
    assert snapshots.latest_files(spark, f"{root}/auchan_*").count() == 5
    assert snapshots.latest_files(spark, f"{root}/auchan_*", f"{root}/sakanal_*", f"{root}/none_*").count() == 14
    time.sleep(1.1)
    spark.range(4).coalesce(1).write.mode("append").parquet(str(root / "auchan_1"))
    assert snapshots.latest_files(spark, f"{root}/auchan_1/*").count() == 4
    with pytest.raises(ValueError):
        snapshots.latest_files(spark, f"{root}/none_*")


def test_parts_of_a_snapshot_are_one_snapshot(spark, tmp_path):
    table = cleaning.analytics(star.raw_listing(spark, SF).limit(50)).cache()
    twice = table.union(table)
    one, many, text = str(tmp_path / "a" / "day"), str(tmp_path / "b" / "day"), str(tmp_path / "c" / "day")
    twice.coalesce(1).write.parquet(one)
    twice.repartition(4).write.parquet(many)
    mart.write_mart({"t": twice}, text, "x", fmt="csv")

    def keys(*args):
        rows = kpi.prepare_history(snapshots.read_history(spark, *args))
        return sorted(tuple(r) for r in rows.select("magasin_standardise", "jour", "cle_matching_exacte", "prix", "source_file").collect())

    assert len(keys([one])) == table.count()
    assert keys([one]) == keys([many])
    from_text = keys([mart.table_path(spark, text, "t", "x")], "csv")
    assert [k[:4] for k in from_text] == [k[:4] for k in keys([one])]
    assert {k[4] for k in from_text} == {"snapshot=x"}


def test_serving_table(spark):
    rows = [("2024-01-02", "12.5", "2", "TRUE"), ("soon", "nan", "x", None)]
    text = spark.createDataFrame(rows, "jour string, prix_obs string, nb_magasins_jour string, comparable_multi_store string")
    got = compare.serving_table(text, "daily_panel").collect()
    assert [(str(r.jour), r.prix_obs, r.nb_magasins_jour) for r in got] == [("2024-01-02", 12.5, 2), ("None", None, None)]
    assert [(r.comparable_multi_store, r.comparabilite_stricte) for r in got] == [(True, True), (False, False)]
    bare = compare.serving_table(text.drop("comparable_multi_store"), "daily_panel").first()
    assert (bare.comparable_multi_store, bare.comparabilite_stricte) == (False, False)


def test_history_union_defaults(spark, tmp_path):
    raw = star.raw_listing(spark, SF).limit(50)
    table = cleaning.analytics(raw)
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    table.write.parquet(new)
    table.drop(*vocab.HISTORY_DEFAULTS, "score_matching").write.parquet(old)
    rows = snapshots.read_history(spark, [new, old])
    assert rows.count() == 2 * table.count()
    assert rows.filter("source_file IS NULL").count() == 0
    assert rows.filter("score_matching IS NULL").groupBy("type_prix_reference").count().count() == 1
    with pytest.raises(ValueError):
        snapshots.history_union([table.drop("prix")])


def test_mart(spark, tmp_path):
    rows = star.raw_listing(spark, SF).filter(F.col("date_scraping") < "1995-06-01")
    history = kpi.prepare_history(snapshots.with_lineage(cleaning.analytics(rows))).cache()
    path = str(tmp_path / "mart")
    mart.publish_mart(spark, history, path, "2024-01-01")
    manifest = mart.mart_manifest(spark, path, "2024-01-01")
    mart.check_mart(manifest)
    assert manifest.count() == len(vocab.MART_TABLES) + 1
    with pytest.raises(RuntimeError, match="daily_panel"):
        mart.check_mart(mart.mart_manifest(spark, path, "2024-01-02"))


def test_a_lost_run_leaves_the_old_mart(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "mart")
    texts = spark.createDataFrame([("a, \"b\"", " x "), (None, "y\\")], "a string, b string")
    mart.write_mart({"t": texts, "u": spark.range(3)}, path, "1", fmt="csv")
    before = mart.mart_entries(spark, path, "1")
    assert before["t"]["rows"] == 2 and not mart.damaged_tables(spark, path, "1")

    class Lost(Exception):
        pass

    def lose(df, folder, fmt="parquet"):
        if folder.endswith("/u/snapshot=1"):
            raise Lost
        return staged(df, folder, fmt)

    staged = mart.stage_table
    monkeypatch.setattr(mart, "stage_table", lose)
    with pytest.raises(Lost):
        mart.write_mart({"t": spark.range(50), "u": spark.range(50)}, path, "1")
    monkeypatch.undo()
    assert mart.mart_entries(spark, path, "1") == before
    assert mart.read_mart(spark, path, "t", "1").count() == 2
    mart.write_mart({"t": spark.range(5)}, path, "1")
    mart.write_mart({"w": spark.range(4)}, path, "2", fmt="json")
    counts = {r.jeu: r.nb_lignes for r in mart.mart_manifest(spark, path, "1", ("t", "u", "w")).collect()}
    assert counts == {"t": 5, "u": 3, "w": None}
    versions.drop_versions(spark, path, keep=1)
    assert mart.read_mart(spark, path, "u", "1").count() == 3 and mart.read_mart(spark, path, "w", "2").count() == 4
    assert len(versions.versions(spark, path)) == 1 and len(list((tmp_path / "mart").glob("v-*"))) == 3
    part = next((tmp_path / "mart" / before["u"]["path"]).glob("part-*.csv"))
    part.write_text("id\n7\n")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert mart.damaged_tables(spark, path, "1") == ["u"]


def test_stream_equals_batch_and_resumes(spark, tmp_path, monkeypatch):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    raw = star.raw_listing(spark, SF).filter(F.col("date_scraping") < "1995-09-01").cache()
    odd = raw.limit(4).withColumns({"prix": F.lit(float("nan")), "nom_produit": F.lit("blanc 500g")}).union(
        raw.limit(4).withColumns({"magasin": F.lit(" "), "nom_produit": F.lit("blanc 1kg")})
    )
    # listings that repeat under another spelling decide which of them stays, whatever file they come in
    again = raw.limit(200).withColumn("nom_produit", F.upper("nom_produit"))
    first = raw.filter(F.col("date_scraping") < "1995-07-01").union(odd)
    first.write.mode("append").parquet(str(inbox))
    merge = ingest.merge_batch

    def run(merge=merge):
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(str(inbox))
        return ingest.run_available(stream, out, merge)

    progress = run()
    assert progress and all(not p["stateOperators"] for p in progress)  # the stream keeps no state
    before = ingest.stored_history(spark, out).count()

    class Lost(Exception):
        pass

    def publish(*args):
        raise Lost

    raw.union(again).repartition(3).write.mode("append").parquet(str(inbox))  # late and repeated rows
    monkeypatch.setattr(ingest, "publish", publish)
    with pytest.raises(Exception, match="Lost"):
        run()
    assert ingest.stored_history(spark, out).count() == before  # a lost batch leaves the history readable
    monkeypatch.undo()
    run()
    got = ingest.stored_history(spark, out)
    everything = raw.union(odd).union(again)
    want = kpi.prepare_history(snapshots.with_lineage(cleaning.analytics(everything))).cache()
    assert got.count() == want.count() > before
    assert got.select(*want.columns).exceptAll(want).count() == 0
    prices = kpi.reliable_prices(want)
    panel = kpi.daily_panel(prices)
    assert ingest.stored(spark, out, "panel").select(*panel.columns).exceptAll(panel).count() == 0
    values = ingest.stored(spark, out, "values")
    for index in (kpi.variation_index, kpi.inflation_category, kpi.inflation_global):
        full = index(prices)
        assert index(values).exceptAll(full).count() == 0 and index(values).count() == full.count() > 0
    kept = versions.read_manifest(spark, out)
    ingest.merge_batch(out, everything, kept["batch"])  # a repeated batch changes nothing
    assert versions.read_manifest(spark, out) == kept


def test_a_first_batch_is_deduplicated_once(spark, tmp_path, monkeypatch):
    raw = star.raw_listing(spark, SF).limit(300).cache()
    merges = []
    monkeypatch.setattr(ingest.cleaning, "dedup_daily", lambda df, *day, kept=ingest.cleaning.dedup_daily: merges.append(day) or kept(df, *day))
    ingest.merge_batch(str(tmp_path / "t"), raw, 0)
    assert merges == [("date_scraping",)]
    ingest.merge_batch(str(tmp_path / "t"), raw, 1)  # all repeats of what is known
    assert merges[1:] == [("date_scraping",), ()]
    got, want = ingest.stored(spark, str(tmp_path / "t"), "rows"), ingest.cleaned_rows(raw).drop("_mois")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    ingest.merge_batch(str(tmp_path / "e"), raw.limit(0), 0)
    assert ingest.stored_history(spark, str(tmp_path / "e")) is None
