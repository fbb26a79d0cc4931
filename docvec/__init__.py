"""docvec: document-vector pipelines expressed as Spark DataFrame jobs."""

import os as _os

# Driver-side numpy only handles parameter-sized matrices; a multi-threaded
# OpenBLAS pool next to the JVM was seen to deadlock, so one thread is used.
for _v in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    _os.environ.setdefault(_v, "1")


def _limit_blas_threads() -> None:
    """Same limit when numpy was imported before this package."""
    try:
        from threadpoolctl import threadpool_limits
        threadpool_limits(1)
        return
    except Exception:  # noqa: BLE001
        pass
    try:
        import ctypes
        import glob

        import numpy as np
        libs = glob.glob(_os.path.join(_os.path.dirname(np.__file__), "..", "scipy_openblas64*", "lib", "*.so*"))
        libs += glob.glob(_os.path.join(_os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*.so*"))
        for path in libs:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_",
                         "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    return
    except Exception:  # noqa: BLE001
        pass


_limit_blas_threads()

__version__ = "0.1.0"
