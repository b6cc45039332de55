"""feedmill: DataFrame operators that turn landed articles, pages and transcripts into features.

Functions that run inside Python tasks travel with their task, so executors need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
