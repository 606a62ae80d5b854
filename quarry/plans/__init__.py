"""Batch plans and the registered driver queries."""
import importlib

_MODULES = ["q_retrieval", "q_text", "q_ops", "q_stream", "q_files", "q_index"]


def load_all():
    from quarry.plans import registry
    for m in _MODULES:
        importlib.import_module(f"quarry.plans.{m}")
    return registry
