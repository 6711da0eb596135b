"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
