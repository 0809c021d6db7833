"""Programs: named views that are stored, reused and looked at, and the fluent form."""

from .fluent import Context, Rel
from .views import (
    Augment, Distinct, Filter, FlatMap, Flatten, Format, Group, Jin, Join, JoinTo, Log, LogEchoFirst, LogProgress, Map, MapPartitions, MapsideJoin, ReadBlocks,
    ReadCSV, ReadLines, ReplaceEach, ReplaceEachPartition, ReuseView, Table, Union, UnionTo, View, Wrap,
)
from .workflow import Workflow

__all__ = [
    "Augment", "Context", "Distinct", "Filter", "FlatMap", "Flatten", "Format", "Group", "Jin", "Join", "JoinTo", "Log", "LogEchoFirst", "LogProgress", "Map", "MapPartitions", "MapsideJoin",
    "ReadBlocks", "ReadCSV", "ReadLines", "Rel", "ReplaceEach", "ReplaceEachPartition", "ReuseView", "Table", "Union", "UnionTo", "View", "Workflow", "Wrap",
]
