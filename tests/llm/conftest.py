import pytest

from .helpers import corpus, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])
