"""Readers (contract loaders, shared-table bindings) and writers."""
