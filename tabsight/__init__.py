"""tabsight: profile, check, prepare and analyse tables with Spark.

Every operator takes a Spark DataFrame and returns a lazy DataFrame (or a
small dict of fitted scalars where a later stage needs them).  The heavy
work is planned by Catalyst; nothing larger than a fitted statistic or a
bounded category list is brought to the driver.
"""

__version__ = "0.1.0"
