"""Court-docket analytics as PySpark DataFrame transformations.

Sub-packages
------------
functions   Column -> Column building blocks (money, dates, text, addresses, rules)
operators   DataFrame -> DataFrame operators (calendar, timeline, extraction, merges)
sources     typed tables, docket-page ingest, views over the sample tables
plans       serving queries and the registry behind ``__spark_entry__``
streaming   incremental intake of docket events
"""
