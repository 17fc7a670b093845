from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docflow.operators import collections, store
from docflow.operators.chunk import chunk_words, with_lineage
from docflow.session import configure
from docflow.streaming import entries


def cut(docs):
    return with_lineage(chunk_words(docs, 2, 0), parts=("chunk_no", "doc_hash" if "doc_hash" in docs.columns else "text"))


def texts(spark, root, name="n"):
    return sorted(r.text for r in collections.open_collection(spark, root, name, "create").collect())


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id string, text string")


def update(spark, root, docs, **how):
    return collections.update_collection(frame(spark, docs), cut, root, "n", **how)


def counts(added=0, changed=0, removed=0):
    return {"added": added, "changed": changed, "removed": removed}


def test_complete_listings(spark, folder):
    root = f"{folder}/index"
    assert update(spark, root, {"a": "one two three", "b": "four"}, complete=True) == counts(added=2)
    assert update(spark, root, {"a": "one two three", "b": "four"}, complete=True) == counts()
    assert update(spark, root, {"a": "new", "c": "five"}, complete=True) == counts(1, 1, 1)
    assert texts(spark, root) == ["five", "new"]
    assert update(spark, root, {"b": "four", "c": "five"}, complete=True) == counts(added=1, removed=1)
    assert texts(spark, root) == ["five", "four"]
    assert update(spark, root, {}, complete=True) == counts(removed=2)
    assert texts(spark, root) == []
    with pytest.raises(collections.CollectionError):
        collections.open_collection(spark, root, "n")


def test_scopes_are_removed_alone_and_batches_remove_nothing(spark, folder):
    root = f"{folder}/index"
    update(spark, root, {"a": "one", "b": "two"}, scope="x", complete=True)
    update(spark, root, {"c": "three"}, scope="y", complete=True)
    assert update(spark, root, {"a": "one"}, scope="x", complete=True) == counts(removed=1)
    assert update(spark, root, {"d": "four"}, scope="x") == counts(added=1)
    assert texts(spark, root) == ["four", "one", "three"]


def test_odd_listings(spark, folder):
    """Null ids are left out; of an id that comes twice one counts, always the same; a null text is empty."""
    root = f"{folder}/index"
    rows = spark.createDataFrame([(None, "no id"), ("a", "one"), ("a", "other"), ("b", None)], "doc_id string, text string")
    assert collections.update_collection(rows, cut, root, "n") == counts(added=2)
    first = texts(spark, root)
    assert len(first) == 1
    assert collections.update_collection(rows.orderBy(F.desc("text")), cut, root, "n") == counts()
    assert texts(spark, root) == first


def test_compaction_drops_what_was_replaced_and_old_parts(spark, folder):
    root = f"{folder}/index"
    for i in range(6):
        update(spark, root, {"a": f"version {i}", f"b{i}": f"kept {i}", "c": "gone" if i < 5 else f"last {i}"})
    update(spark, root, {"a": "version 5", **{f"b{i}": f"kept {i}" for i in range(6)}}, complete=True)
    before, place = texts(spark, root), collections.store_root(root, "n")
    assert before == sorted(["version 5", *(f"kept {i}" for i in range(6))])
    old = store.manifest(spark, place)
    assert old.stale == 7 and max(len(p) for p in old.parts.values()) > 1
    collections.compact_collection(spark, root, "n", many=0, keep=1)
    new = store.manifest(spark, place)
    assert new.stale == 0 and [len(p) for p in new.parts.values()] == [1, 1] and texts(spark, root) == before
    assert store.read_table(spark, place, new, "nodes").count() == 7
    assert not any(store._names(spark, f"{place}/{p.path}") for parts in old.parts.values() for p in parts)
    assert update(spark, root, {"c": "back"}) == counts(added=1)
    assert texts(spark, root) == sorted([*before, "back"])


def test_a_broken_run_leaves_nothing_and_can_be_repeated(spark, folder):
    root = f"{folder}/index"
    update(spark, root, {"a": "one"})

    def broken(docs):
        return cut(docs).withColumn("text", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        collections.update_collection(frame(spark, {"a": "two"}), broken, root, "n")
    assert texts(spark, root) == ["one"]
    assert update(spark, root, {"a": "two"}) == counts(changed=1)
    assert texts(spark, root) == ["two"]


def test_of_two_runs_from_one_manifest_the_second_fails(spark, folder):
    held = store.commit(spark, folder, None, {})
    store.commit(spark, folder, held, {})
    with pytest.raises(store.StoreConflict):
        store.commit(spark, folder, held, {})
    assert store.manifest(spark, folder).version == 2


def test_only_new_and_changed_documents_are_cut_and_only_their_buckets_read(spark, folder):
    root = f"{folder}/index"
    seen = []

    def watched(docs):
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        return cut(docs)

    for docs in ({f"d{i}": f"text {i}" for i in range(50)}, {"d1": "text 1", "d2": "changed", "new": "x"}, {"d1": "text 1"}):
        collections.update_collection(frame(spark, docs), watched, root, "n")
    assert seen[1:] == [["d2", "new"]] and len(seen[0]) == 50
    known = collections.current_documents(spark, root, "n", [3, 5])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket IN (3,5)" in plan.replace("#", " ").replace("  ", " ") or "PartitionFilters: [" in plan
    assert {r.bucket for r in known.collect()} <= {3, 5}


def test_settings_of_a_session_do_not_matter(spark, folder):
    """A collection of another session of the same cluster is seen as it is."""
    root = f"{folder}/index"
    update(spark, root, {"a": "one"})
    assert texts(configure(spark.newSession()), root) == ["one"]


def test_entries_expire_once_and_late_writes_lose(spark, folder):
    def put(*rows):
        entries.put_entries(spark.createDataFrame(rows, "key string, written_at timestamp, ttl_s long, s string").repartition(2), folder)

    def at(minute):
        return datetime(2024, 1, 1, 10, minute)

    def live(minute):
        return sorted((r.key, r.s) for r in entries.live_entries(spark, folder, at(minute)).collect())

    def expire(minute):
        return sorted((r.key, r.s) for r in entries.expire_entries(spark, folder, at(minute)).collect())

    assert entries.live_entries(spark, folder, at(0)) is None and entries.expire_entries(spark, folder, at(0)) is None
    put(("a", at(0), 300, "a0"), ("a", at(2), 300, "a2"), ("b", at(0), None, "b0"), (None, at(0), 1, "none"), ("c", at(1), 60, "c1"))
    put(("a", at(1), 6000, "late"), ("c", at(1), 60, "c1"))
    assert live(1) == [("a", "a2"), ("b", "b0"), ("c", "c1")] and live(6) == [("a", "a2"), ("b", "b0")] and live(7) == [("b", "b0")]
    assert expire(6) == [("c", "c1")] and expire(6) == []
    put(("c", at(0), 9999, "older"))
    assert live(6) == [("a", "a2"), ("b", "b0")]
    entries.compact_entries(spark, folder, many=0)
    put(("c", at(1), None, "same time, stored later"), ("d", at(0), 1, "d0"))
    assert expire(30) == [("a", "a2"), ("d", "d0")]
    assert live(30) == [("b", "b0"), ("c", "same time, stored later")]
