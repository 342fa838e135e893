from grantlens.sources.tables import read_table, applications_raw, requests_from_orders
from grantlens.sources.applications import APPLICATION_COLUMNS, load_applications

__all__ = ["read_table", "applications_raw", "requests_from_orders",
           "APPLICATION_COLUMNS", "load_applications"]
