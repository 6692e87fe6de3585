"""Where the repository and its test tables are."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
