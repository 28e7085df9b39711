"""regionwatch.operators"""
