"""orderlens: seller order / return analytics as Spark DataFrame jobs.

Every operator computes its result for all sellers (or any scope key such
as ``(seller_id, upload_id)``) in one distributed job.
"""

__version__ = "0.1.0"
