"""vectide: multivariate time-series analytics on PySpark.

Spark code builds ordered designs and reduces them to Gram matrices; NumPy
kernels work on the small k x k results or on independent (window, chain) groups.
"""

from vectide._ship import ship_by_value

ship_by_value()
