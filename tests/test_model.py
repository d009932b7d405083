"""The derived model tables have the row counts FIXTURES.md lists."""

import pytest

from data_paths import SF001, SF01
from gazette.sources.model import Model

# Row counts of the fixture views (FIXTURES.md).
COUNTS = {
    SF001: {"media": 20, "users": 150, "article": 200, "pending": 113, "article_translation": 273,
            "user_media": 147, "artifact": 799, "ready": 53, "user_article": 100,
            "user_article_all_langs": 113, "job_message": 1000, "completion": 87},
    SF01: {"media": 20, "users": 1500, "article": 1000, "pending": 601, "article_translation": 1380,
           "user_media": 1456, "artifact": 7986, "ready": 543, "user_article": 9849,
           "user_article_all_langs": 10935, "job_message": 10000, "completion": 536},
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_fixture_counts(spark, sf):
    from gazette.operators.deliver import subscription_fanout

    m = Model(spark, sf)
    got = {
        "media": m.media().count(), "users": m.users().count(), "article": m.article().count(),
        "pending": m.article().where("s3_prefix = ''").count(),
        "article_translation": m.article_translation().count(), "user_media": m.user_media().count(),
        "artifact": m.artifact().count(), "ready": m.ready().count(),
        "user_article": m.user_article().count(),
        "user_article_all_langs": subscription_fanout(m.ready(), m.article(), m.user_media(),
                                                      all_langs=True).count(),
        "job_message": m.job_message().count(), "completion": m.completion().count(),
    }
    assert got == COUNTS[sf]
