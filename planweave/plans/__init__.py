"""planweave.plans"""
