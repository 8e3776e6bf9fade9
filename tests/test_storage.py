"""Tables laid out so that joins, windows and reads by user need no shuffle and open no other folder."""

import re
import uuid

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docfold.operators import history, migrate, stats
from docfold.sources.fixtures import Tables, now
from docfold.sources.tables import SCHEMAS, read_table, user_bucket, write_bucketed, write_table


@pytest.fixture
def by_chat(spark, tmp_path):
    """Messages, votes and chats in buckets by chat, documents by user."""
    t, made = Tables(spark, DATA), {}
    for name, df, key in (("messages", t.messages(), "chat_id"), ("votes", t.votes(), "chat_id"), ("chats", t.chats(), "id"), ("knowledge_documents", t.knowledge_documents(), "user_id")):
        made[name] = write_bucketed(df, str(tmp_path), name, key, f"{name}_{uuid.uuid4().hex}", 8)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield made
    for k, v in old.items():
        spark.conf.set(k, v)


def shuffles(df):
    """What the rows of the physical plan are dealt by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (hashpartitioning\([^)]*\)|RoundRobin\S*|Single\S*)", plan)]


def test_messages_by_chat_meet_without_a_shuffle(by_chat):
    m, v, c = by_chat["messages"], by_chat["votes"], by_chat["chats"]
    cut = m.filter("role = 'user'").groupBy("chat_id").agg(F.max("created_at").alias("ts"))
    left, votes = history.truncate_messages(m, v, cut)
    assert shuffles(left) == [] and shuffles(votes) == []
    # Only the counts per chat travel, to their users.
    assert shuffles(stats.message_count(m, c, now(False))) == ["hashpartitioning(user_id, 4)"]
    # Without the layout messages travel by chat.
    t = Tables(m.sparkSession, DATA)
    assert any("chat_id" in x for x in shuffles(stats.message_count(t.messages(), t.chats(), now(False))))
    assert left.count() == history.truncate_messages(t.messages(), t.votes(), cut)[0].count() > 0


def test_migration_of_bucketed_messages_needs_no_shuffle(by_chat):
    out, kept = migrate.migrate_messages(by_chat["messages"].select("id", "chat_id", "role", "content", "created_at"), by_chat["votes"])
    assert shuffles(out.drop("parts", "attachments")) == [] and shuffles(kept) == []


def test_documents_by_user_need_no_shuffle(by_chat):
    assert shuffles(history.list_documents(by_chat["knowledge_documents"])) == []


def test_reads_by_user_open_their_folders_alone(spark, tmp_path):
    docs = Tables(spark, DATA).knowledge_documents().withColumn("user_id", F.col("id") % 40)
    write_table(docs, str(tmp_path), "knowledge_documents")
    want = sorted(r.id for r in docs.filter("user_id in (3, 17)").collect())
    folders = {r.b for r in spark.createDataFrame([(3,), (17,)], "u long").select(user_bucket(F.col("u")).alias("b")).collect()}
    few = read_table(spark, str(tmp_path), "knowledge_documents", users=[3, 17])
    assert sorted(r.id for r in few.collect()) == want and few.columns == [x.split()[0] for x in SCHEMAS["knowledge_documents"].split(", ")]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    asked = read_table(spark, str(tmp_path), "knowledge_documents", users=spark.createDataFrame([(3,), (17,), (3,)], "user_id long"))
    assert sorted(r.id for r in asked.collect()) == want and asked.columns == few.columns
    assert len(folders) <= 2
    assert read_table(spark, str(tmp_path), "knowledge_documents", users=[]).count() == 0
    assert sorted(r.id for r in read_table(spark, str(tmp_path), "knowledge_documents").collect()) == sorted(r.id for r in docs.collect())
