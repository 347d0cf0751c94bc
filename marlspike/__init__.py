"""marlspike: text and project intelligence expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# workers may not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
