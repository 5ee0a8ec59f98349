"""corpusprep: Spark jobs that prepare and evaluate training corpora for
masked-diffusion text and molecule models.

Every operator is a function ``DataFrame -> DataFrame`` (or
``Column -> Column``); nothing holds state and nothing loops over rows on
the driver.
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
