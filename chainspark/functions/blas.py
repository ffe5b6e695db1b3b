"""Numpy's matrix products inside Spark tasks."""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np


def one_thread() -> None:
    """Hold numpy's matrix products to one thread: a Spark task has one core, and waiting threads would burn others'."""
    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        blas = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(blas, name):
                getattr(blas, name)(1)
                break
