"""shelfspark: a Spark-native market-intelligence data engine.

Crawled pages become product, review, ad and trend tables; products are de-duplicated into a SKU
catalogue and a category -> brand -> model -> variant taxonomy; a daily entity panel is compared
with forecasts, scored for drift and served through read queries. Everything is DataFrame / SQL /
ML / Structured Streaming code.
"""

__version__ = "0.1.0"
