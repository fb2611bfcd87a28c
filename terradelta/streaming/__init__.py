"""Interaction streams: debounce, latest request, provisional and final results."""
