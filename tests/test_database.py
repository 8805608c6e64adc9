"""A read-only session against the embedded database of Spark's jars."""

import pytest

from tierscope.sources import database


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    """Documents and files of two collections; the database lets new connections read only."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby') / 'db'}"
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    c = spark._jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    s = c.createStatement()
    s.execute("CREATE TABLE documents (id INT, version INT, collection VARCHAR(20))")
    s.execute("CREATE TABLE files (document INT, path VARCHAR(20), size BIGINT)")
    for i in range(40):
        s.execute(f"INSERT INTO documents VALUES ({i}, {i * 10}, '{'publications' if i % 2 else 'other'}')")
        s.execute(f"INSERT INTO files VALUES ({i}, 'f{i}', {i * 1000})")
    s.execute("INSERT INTO files VALUES (NULL, 'none', NULL)")
    yield url, s
    c.close()


DOCUMENTS = "SELECT id, version FROM documents WHERE collection = 'publications'"
FILES = "SELECT document, path, size FROM files"


def test_nothing_is_read_before_the_database_confirms(spark, derby):
    url, s = derby
    session = database.ReadOnlySession(spark, url, database.DERBY)
    with pytest.raises(database.NotReadOnly):
        session.read(DOCUMENTS)
    assert session.evidence == {"read_only": False, "statements": ["select"]}
    s.execute("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.database.defaultConnectionMode', 'readOnlyAccess')")
    documents, files = session.read(DOCUMENTS, by="id", partitions=4), session.read(FILES, by="document", partitions=3)
    assert (documents.rdd.getNumPartitions(), files.rdd.getNumPartitions()) == (4, 3)
    assert sorted(tuple(r) for r in documents.collect()) == [(i, i * 10) for i in range(1, 40, 2)]
    assert files.count() == 41 and files.where("document IS NULL").count() == 1
    assert session.evidence["read_only"] and set(session.evidence["statements"]) == {"select"}
    assert session.read("SELECT id FROM documents WHERE id > 99", by="id").count() == 0


def test_writes_are_refused(spark, derby):
    url, s = derby
    s.execute("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.database.defaultConnectionMode', 'readOnlyAccess')")
    session = database.ReadOnlySession(spark, url, database.DERBY)
    for bad in ("DELETE FROM files", "INSERT INTO files VALUES (1, 'x', 1)", "CALL f()", "BEGIN", "SET x = 1", ""):
        with pytest.raises(ValueError):
            session.read(bad)
    # A session like those of the executors can't write either.
    with pytest.raises(Exception, match="(?i)read-only|readonly|25502|25503"):
        spark.createDataFrame([(1, "x", 1)], "document int, path string, size long").write.format("jdbc").option("url", url).option("dbtable", "files").mode("append").save()
    assert session.read(FILES).count() == 41
