"""Every sample query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect
from conftest import SMALL
from reqsieve.samples import oracle
from reqsieve.samples.queries import QUERIES

# Fits over all columns have no SQL: their siblings over one column have (``*_saturated``),
# and test_models.py checks them.
TRAINED = {"train_lr", "train_wide", "tune_lr", "score_trained", "holdout_trained"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query(spark, duck, name):
    assert compare(spark, duck, SMALL, name) == ""


def test_only_trained_results_lack_sql():
    assert set(QUERIES) - set(oracle.oracle_sql()) == TRAINED
    assert set(oracle.oracle_sql()) <= set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
