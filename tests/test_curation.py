import os

import pytest

from weirstone.plans.curation import Vocabulary, curate, normalise
from weirstone.queries import vocabulary as V
from weirstone.sources.tables import table

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline(spark):
    v = Vocabulary(V.CORE, V.SUPPORT, V.DEPARTMENTS, V.REGIONS, V.TOPICS, V.ENTITIES)
    kb, inbox = table(spark, DIR, "kb"), table(spark, DIR, "inbox")
    out = curate(kb, inbox, v)
    n = out["records"].count()
    assert kb.count() <= n <= kb.count() + inbox.count()
    assert out["records"].select("seq").distinct().count() == n
    assert all(t.count() > 0 for k, t in out.items() if k != "edges")
    once = normalise(kb, v)
    assert once.exceptAll(normalise(once, v)).count() == 0 if "topic_score" not in once.columns else once.drop("topic_score").exceptAll(normalise(once, v).drop("topic_score")).count() == 0
