import pytest


@pytest.fixture(autouse=True, scope="session")
def key_of_pseudonyms(spark):
    """The tests' own key; outside them it is the session's."""
    from tramline.llm.pii import KEY_SETTING

    spark.conf.set(KEY_SETTING, "corpus-1")
