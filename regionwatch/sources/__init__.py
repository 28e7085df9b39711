"""regionwatch.sources"""
