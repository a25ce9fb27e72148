"""recensio: customer-review analytics as Spark DataFrame operators.

Pages or review tables go in; cleaned reviews, TF-IDF topics, text blocks,
merged model insights, theme frequencies and report tables come out.  Every
operator is a DataFrame -> DataFrame function (see ``recensio.operators``).
"""

from recensio.config import Config

__all__ = ["Config"]
