"""regionwatch.plans"""
