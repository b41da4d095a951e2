from codelore.streaming import typelib


def test_library_grows_with_arriving_files(spark, tmp_path):
    source, library, state = (str(tmp_path / n) for n in ("in", "lib", "state"))
    schema = "size long, type_str string"
    for rows in ([(4, "int"), (4, "int"), (8, "long")], [(4, "int"), (1, "char")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        typelib.update_typelib(typelib.variables_stream(spark, source, schema), library, state).awaitTermination()
    got = {(r["size"], r["type_str"]): r["freq"] for r in typelib.read_typelib(spark, library).collect()}
    assert got == {(4, "int"): 3, (8, "long"): 1, (1, "char"): 1}
