"""quarry: exploratory data analysis as Spark jobs.

Every public operator takes a DataFrame (plus options) and returns a
DataFrame; nothing is collected to the driver unless the docstring says
so, and the few driver-side values are single aggregate rows.
"""

__version__ = "0.1.0"
