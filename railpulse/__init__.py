"""Payment-rail health analytics expressed as Spark DataFrame plans."""

from railpulse.plans.catalog import DATASETS, dataset
from railpulse.sources.tables import PaymentTables, load_tables

__all__ = ["DATASETS", "PaymentTables", "dataset", "load_tables"]
