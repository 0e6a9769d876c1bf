import sys
from pathlib import Path

HERE = str(Path(__file__).parent)
sys.path[:0] = [HERE]
