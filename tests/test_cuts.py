"""Results do not depend on day borders, and work folders are shared ones."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lurelens.functions.stages import unpacked
from lurelens.operators import domains, enrichment
from lurelens.session import work_folder


def test_cache_label_depends_on_age_alone(spark):
    asked = spark.sql("""SELECT * FROM VALUES (1L, 0, 'u', TIMESTAMP '2024-01-03 00:30:00'), (2L, 0, 'u', TIMESTAMP '2024-01-02 22:00:00'), (3L, 0, 'U', TIMESTAMP '2024-01-01 20:00:00'),
        (4L, 0, 'v', TIMESTAMP '2024-01-03 23:00:00'), (5L, 0, NULL, TIMESTAMP '2024-01-03 23:00:00'), (6L, 0, 'v', TIMESTAMP '2024-06-03 23:00:00'), (7L, 0, 'u', TIMESTAMP '2024-01-01 23:30:00') AS t(id, pos, url, ts)""")
    seen = spark.sql("""SELECT * FROM VALUES ('u', TIMESTAMP '2024-01-01 23:30:00', 'completed', 3, 0), ('v', TIMESTAMP '2024-01-02 00:30:00', 'completed', 4, 1) AS t(key, observed_at, status, malicious, suspicious)""")
    got = {r.id: (r.cache, r.malicious) for r in enrichment.cached_as_of(asked, seen).collect()}
    assert got == {1: ("expired", None), 2: ("hit", 3), 3: ("miss", None), 4: ("expired", None), 5: ("miss", None), 6: ("expired", None), 7: ("hit", 3)}


def test_work_folder_needs_a_shared_path_on_a_cluster(spark):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        work_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    shared = SimpleNamespace(get=lambda key, default=None: "/shared/")
    assert work_folder(SimpleNamespace(conf=shared)).startswith("/shared/lurelens-")


def test_filters_on_ids_pass_the_seals(spark, tmp_path):
    spark.sql("SELECT 5L AS id, 'a@b.com' AS from_email, 'c@d.com' AS reply_to, array('http://x.org/') AS urls").write.parquet(str(tmp_path / "mails"))
    mails = spark.read.parquet(str(tmp_path / "mails"))
    for rows in (unpacked(mails, ["id"], F.col("urls"), "pos", "url"), domains.trust_score(mails)):
        plan = rows.filter("id = 5")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id,5)" in plan.split("PushedFilters:")[1].split("]")[0]
        assert rows.filter("id = 5").count() == 1 and rows.filter("id = 6").count() == 0
