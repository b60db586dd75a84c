"""Analytics over catalogs of media assets, as Spark DataFrame operators."""
