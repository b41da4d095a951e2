"""What a task holds and how often a step runs, on small tables with small bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.operators import lineage, trees, typelib
from codelore.plans import examples, views

DATA = "/root/testdata/sf0.001"


def most_in_a_task(rows):
    return rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS", 200)
    v, nodes = views.variables(spark, DATA), views.trees(spark, DATA)
    assert v.count() > 5000 and nodes.count() > 7000
    grouped = v.groupBy("func", "loc").agg(F.count("*").alias("n"))
    assert max(map(most_in_a_task, (v, nodes, grouped, trees.subtree_size(nodes), examples.c3(spark, DATA)))) < 1000
    for rows, key in ((v, "func"), (nodes, "tree")):
        places = rows.select(key, F.spark_partition_id().alias("p")).distinct()
        assert places.groupBy(key).count().where("count > 1").isEmpty()


def test_both_sides_and_ways_in_one_pass(spark):
    """No branch a side, kind or way, of which each would read and join all tables again."""
    edges = trees.with_reverse(spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "tree long, src long, dst long"))
    assert sorted(map(tuple, edges.collect())) == [(1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 2, 0)]
    for rows in (edges, examples.c1(spark, DATA), examples.c3(spark, DATA), examples.c14(spark, DATA)):
        assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_layouts_that_many_share_are_cut_once(spark):
    index = spark.createDataFrame([(5, [0, 1, 2, 3], [0], 4, 2, 7)], "layout_id long, accessible array<long>, starts array<long>, size long, names long, first long")
    sizes = spark.createDataFrame([(4,), (4,), (8,), (900,), (0,)], "size long")
    stack = spark.createDataFrame([(i, [0, 1, 2, 3, 4], [0, 4]) for i in range(40)] + [(40, [], [])], "id long, accessible array<long>, starts array<long>")
    found = typelib.replacements_of(stack.select("accessible", "starts"), index, sizes)
    assert [[tuple(c) for c in r["cuts"]] for r in found.collect()] == [[(4, 5, [4], [4], 2, 7)]]
    got = typelib.next_replacements(stack, index, sizes)
    assert got.columns == ["id", "cut", "layout_id", "rest_accessible", "rest_starts", "names", "first"]
    assert sorted((r["id"], r["layout_id"], r["names"], r["first"]) for r in got.collect()) == [(i, 5, 2, 7) for i in range(40)]


def test_small_members_go_on_together(spark, tmp_path, monkeypatch):
    import pandas as pd

    from codelore.sources import shards

    shards.write_shards(spark.range(300).select(F.lit("s").alias("shard"), F.concat("id", F.lit(".json")).alias("member"), F.concat(F.lit("x"), "id").alias("text")), str(tmp_path / "out"))
    rows = shards.shard_members(spark, str(tmp_path / "out")).toPandas()
    frames = []

    class Dealt:
        def mapInPandas(self, whole, schema):
            frames.extend(whole(iter([rows])))

    monkeypatch.setattr(shards, "_dealt", lambda *a: Dealt())
    shards.scan_members(spark, str(tmp_path / "out"))
    got = pd.concat(frames)
    assert len(frames) == 1 and dict(zip(got["member"], got["text"])) == {f"{i}.json": f"x{i}" for i in range(300)}
    frames.clear()
    monkeypatch.setattr(shards, "TEXT", 100)
    shards.scan_members(spark, str(tmp_path / "out"))
    assert 10 < len(frames) < 40 and sum(map(len, frames)) == 300


def test_a_member_comes_in_pieces(spark, tmp_path, monkeypatch):
    """a binary's member isn't one row, and no pattern runs over the path of each line."""
    import tarfile

    from codelore.plans import sources
    from codelore.sources import shards

    piece = F.col("id").cast("long").alias("piece")
    text = F.when(F.col("id") != 150, F.concat("id", F.lit("é\n"))).alias("text")
    rows = spark.range(300).select((F.col("id") % 2).alias("shard"), F.concat(F.col("id") % 3, F.lit(".jsonl")).alias("member"), text, piece)
    monkeypatch.setattr(shards, "TEXT", 50)
    shards.write_shards(rows.repartition(7), str(tmp_path / "out"))
    for shard in (0, 1):
        with tarfile.open(tmp_path / "out" / f"{shard}.tar") as tar:
            got = {m.name: tar.extractfile(m).read().decode() for m in tar}
            assert len(tar.getmembers()) == 3
        assert got == {f"{m}.jsonl": "".join(f"{i}é\n" for i in range(300) if i % 2 == shard and i % 3 == m and i != 150) for m in range(3)}

    longest = []
    write = shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda rows, path: (longest.append(rows.agg(F.max(F.length("text"))).first()[0]), write(rows, path)))
    read = sources.a9_written(spark, DATA)
    assert longest[0] < 300 and "regexp" not in read._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_round_counts_the_words_of_its_own_merges(spark, monkeypatch):
    """words that an earlier round has changed aren't cut and counted again in every later one."""
    from codelore.operators import vocab

    words = spark.createDataFrame([("ab" + "xyz"[i % 3] + c + "cd" * (i % 2), 50 - i) for i, c in enumerate("efghijklmnopqrstuvw")], "word string, freq long")
    counted = []
    count = vocab.pair_counts
    monkeypatch.setattr(vocab, "pair_counts", lambda state: (counted.append({r["p"] for r in state.collect()}), count(state))[1])
    found = [(r["left"], r["right"]) for r in vocab.learn_bpe(words, 8).orderBy("rank").collect()]
    assert found[0] == ("a", "b") and len(counted) > 3
    # The first merge changes every word, which is counted before and after; later rounds meet words as the last one left them.
    assert len(counted[1]) == 38 and not any("\ufdd0a\ufdd1" in p for x in counted[2:] for p in x)


def test_two_runs_over_the_same_variables_read_them_once(spark):
    """a run that is made of the rows of the other isn't joined to it, and of the lines only those of test functions meet their parts."""
    from codelore.plans import evaluation

    reads = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert reads(evaluation.k10(spark, DATA)) == 1
    assert reads(views.type_counts(spark, DATA)) == 1
    train, test = views.train_counts_and_test(spark, DATA)
    assert reads(train) == 0 and reads(test) == 1
    v = views.variables(spark, DATA)
    kept = v.join(views.split(v).where("split = 'test'").select("bin"), "bin", "left_semi")
    assert kept.count() == test.count() > 100 and kept.exceptAll(test.select(kept.columns)).isEmpty()


def test_two_runs_on_odd_rows_equal_sql(spark, tmp_path):
    """types and names that are missing or empty, parts and orders that are missing, no test binary."""
    import duckdb

    import __spark_entry__ as entry

    parts = [(i, None if i % 13 == 0 else "" if i % 7 == 0 else f"hot w{i % 5}", f"Brand#{i % 3}", None if i % 4 == 0 else ("LARGE", "Brand#1", "PROMO")[i % 3], i % 20) for i in range(30)]
    lines = [(o, (o * 7 + k * 11) % 33, k, k + 1, float(k), None, "RAN"[k % 3], "FO"[k % 2], float(o % 50)) for o in range(400) for k in range(1 + o % 6)]
    for binaries in (40, 9):
        tables = {
            "orders": ([(i, i % binaries) for i in range(380)], "o_orderkey long, o_custkey long"),
            "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
            "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double"),
        }
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{binaries}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{binaries}/{name}.parquet/*.parquet')")
        name = "k10_cross_model_conditional"
        got = tuple(entry.queries()[name](spark, f"{tmp_path}/{binaries}").first())
        assert got == con.execute(entry.oracle_sql()[name]).fetchall()[0]
        assert all(0 < x < 1 for x in got) if binaries == 40 else got == (None, None)
