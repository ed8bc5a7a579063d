"""Operators for preparing large-scale language-model training data."""
