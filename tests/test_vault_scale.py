"""Vaults are dealt by profile before their texts are sorted, and never broadcast."""

from leafmark.operators import vault
from leafmark.plans import catalog_schema

SF = "/root/testdata/sf0.001"


def test_derived_values_are_dealt_before_they_are_sorted(spark):
    """All profiles of a split were sorted in the one task that read it."""
    shown = vault.derived(catalog_schema.vault_rows(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert shown.count("REPARTITION_BY_NUM") == 1 and shown.count("Exchange") == 1


def test_no_vault_is_broadcast(spark):
    """The file of a vault's parts is small where its entries are not; their hash map was over 2 GB in each executor."""
    shown = catalog_schema.vault_resolve(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown and shown.count("SortMergeJoin") == 3
