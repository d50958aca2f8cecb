"""The transactional store and what is built on it: snapshots, and an index that follows its documents."""

import threading

import pytest
from pyspark.sql import functions as F

from foliant.operators import embedding, export
from foliant.operators.store import CHECKPOINT_EVERY, Conflict, Store, transact
from foliant.plans.api import Engine
from foliant.plans.incremental import LiveIndex


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_writer_that_dies_between_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    transact(store, lambda t: t.put("s", {"chunks": spark.range(3), "pages": spark.range(2)}))
    t = store.begin()
    t.write("s", "chunks", spark.range(100))  # and no more: no commit
    v = store.version()
    assert (v.number, store.read("chunks", v).count(), store.read("pages", v).count()) == (1, 3, 2)
    assert store.vacuum(older_than=3600) == 0
    assert store.vacuum(older_than=-1) == 1
    assert store.read("chunks").count() == 3


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, second, other = store.begin(), store.begin(), store.begin()
    first.put("s", {"rows": spark.range(1)})
    second.put("s", {"rows": spark.range(2)})
    other.put("o", {"rows": spark.range(10, 13)})
    assert first.commit().number == 1
    with pytest.raises(Conflict):
        second.commit()
    assert other.commit().number == 2  # another entry: both stand
    assert ids(store.read("rows")) == [0, 10, 11, 12]
    tries = []

    def change(t):
        tries.append(t.base.number)
        if len(tries) == 1:
            transact(store, lambda u: u.put("s", {"rows": spark.range(4)}))
        t.put("s", {"rows": spark.range(5)})

    assert transact(store, change).number == 4
    assert tries == [2, 3]
    assert store.read("rows", entry="s").count() == 5


def test_names_of_versions_are_taken_once(spark, tmp_path):
    store, won = Store(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda k=k: won.append(store.files.create(store._at(1), f'{{"k": {k}}}'))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]
    assert store.files.names(f"{tmp_path}/_log") == ["00000000000000000001.json"]


def test_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    held = None
    for k in range(CHECKPOINT_EVERY + 2):
        v = transact(store, lambda t, k=k: t.put(f"e{k % 3}", {"rows": spark.range(k, k + 1)}, k=k))
        held = held or v
    assert ids(store.read("rows", held)) == [0]
    assert {e["k"] for e in store.version().entries.values()} == {CHECKPOINT_EVERY - 1, CHECKPOINT_EVERY, CHECKPOINT_EVERY + 1}
    assert store.version(2).entries.keys() == {"e0", "e1"}
    assert Store(spark, str(tmp_path)).version().number == CHECKPOINT_EVERY + 2
    transact(store, lambda t: t.remove("e0"))
    assert store.version().entries.keys() == {"e1", "e2"}
    with pytest.raises(ValueError):
        store.version(99)


def test_snapshots_are_whole(spark, tmp_path):
    store = export.SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    old = store.save({"chunks": rows, "pages": rows}, "a", "A", 1)
    store.save({"chunks": rows.limit(1), "pages": rows}, "b", "B", 2)
    store.save({"chunks": rows.limit(2), "pages": rows}, "a", "A2", 1)
    assert store.load("chunks", "a").count() == 2
    assert store.load("chunks", "a", old).count() == 3  # a reader that opened the first version
    assert [r["title"] for r in store.list().collect()] == ["A2", "B"]
    store.delete("a")
    assert [r["title"] for r in store.list().collect()] == ["B"]
    assert store.load("chunks", "a").count() == 0


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, title string")


def rebuilt(spark, rows):
    return Engine.index(documents(spark, [r for r in rows if r[0] is not None]))


def same(index, engine):
    for name in ("chunks", "pages", "titles"):
        a, b = index.table(name).drop("generation"), getattr(engine, name)
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


def test_incremental_index(spark, tmp_path):
    texts = {k: f"Heading {k}\n\nA text about the matter number {k} of some length.\n- a list\n- of two" for k in range(1, 9)}
    rows = [(k, t, f"t{k}") for k, t in texts.items()]
    index = LiveIndex(spark, str(tmp_path))
    index.update(documents(spark, rows))
    same(index, rebuilt(spark, rows))
    before = index.store.version()

    embedded = []

    def embed(chunks, page_count):
        embedded.append(sorted(r[0] for r in chunks.select("doc_id").distinct().collect()))
        return embedding.embed(chunks, page_count)

    changed = [r for r in rows if r[0] != 3]  # 3 is gone
    changed = [(k, "Quite another text, longer than before.\n" * 50 if k == 5 else t, "new title" if k == 6 else title) for k, t, title in changed]
    changed += [(20, None, "null"), (21, "", "empty"), (None, "no id", "x")]
    index.update(documents(spark, changed), embed=embed)
    assert embedded == [[5, 6, 20, 21]]
    same(index, rebuilt(spark, changed))
    assert sorted(r["doc_id"] for r in index.table("titles", before).collect()) == list(range(1, 9))  # the older version is whole

    number = index.store.version().number
    assert index.update(documents(spark, changed)).number == number  # nothing has changed
    index.update(documents(spark, [(3, texts[3], "t3")]), whole=False, deleted=spark.createDataFrame([(1,), (99,)], "doc_id long"))
    now = [r for r in changed if r[0] != 1] + [(3, texts[3], "t3")]
    same(index, rebuilt(spark, now))
    index.compact()
    assert len(index.store.version().entries) == 1
    same(index, rebuilt(spark, now))
    index.update(documents(spark, []))
    assert index.table("chunks").count() == 0 and index.live().count() == 0


def test_incremental_index_with_two_writers(spark, tmp_path):
    """The second of two updates from one version is made again on top of the first."""
    index, other = LiveIndex(spark, str(tmp_path)), LiveIndex(spark, str(tmp_path))
    index.update(documents(spark, [(1, "one text", "a")]))

    def embed(chunks, page_count):
        if index.store.version().number == 1:
            other.update(documents(spark, [(2, "two texts", "b")]), whole=False)
        return embedding.embed(chunks, page_count)

    index.update(documents(spark, [(3, "three texts", "c")]), whole=False, embed=embed)
    assert ids(index.live().select("doc_id")) == [1, 2, 3]
    same(index, rebuilt(spark, [(1, "one text", "a"), (2, "two texts", "b"), (3, "three texts", "c")]))


def test_rows_that_repeat_an_id(spark, tmp_path):
    index = LiveIndex(spark, str(tmp_path))
    index.update(documents(spark, [(1, "one", "a"), (1, "two", "a"), (1, "two", "a")]))
    assert index.table("titles").count() == 1 and index.table("chunks").count() == 1
    assert index.update(documents(spark, [(1, "two", "a"), (1, "one", "a")])).number == 1
    assert index.engine().search(spark.createDataFrame([(1, "one two")], "query_id long, text string")).select(F.count(F.lit(1))).first()[0] == 1
