"""Declared controls and their fused evaluation."""
