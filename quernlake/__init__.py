"""Row-group pruning and exact filtering for columns of JSON documents, as Spark plans."""

from quernlake.operators.evaluate import candidates
from quernlake.operators.index import Index, build_index
from quernlake.plans.config import Config
from quernlake.plans.predicates import EQ, GT, GTE, IN, LT, LTE, NE, NIN, Contains, InSubnet, IsNotNull, IsNull, Predicate, Regex, aliased

__all__ = ["EQ", "GT", "GTE", "IN", "LT", "LTE", "NE", "NIN", "Config", "Contains", "InSubnet", "Index", "IsNotNull", "IsNull", "Predicate", "Regex", "aliased", "build_index", "candidates"]
