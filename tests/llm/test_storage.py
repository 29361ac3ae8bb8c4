import os

from sigloom.llm import storage


def test_tables_are_shared_and_cleaned(spark):
    df = storage.materialise(spark.range(5), "five")
    folder = storage.shared_dir(spark)
    assert df.count() == 5 and folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert any(n.startswith("five-") for n in os.listdir(folder.removeprefix("file:")))
    storage.clean(spark)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_registered_for_each_operator():
    from sigloom.llm.queries import ORACLE, QUERIES

    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 14)) and len(QUERIES) == 13
    assert set(ORACLE) <= set(QUERIES)
